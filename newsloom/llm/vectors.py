"""Embedding near-dedup (operator 6): Euclidean p-stable hashing in several tables, then exact cosine checks.

Vectors are normalised and projected on Gaussian directions; projections are shifted, divided by a
width and rounded down, and a table's key is the hash of its quantised projections. The number of
projections grows with the number of vectors so that chance partners in a bucket stay few, and the
number of tables follows from the recall wanted at the threshold. Equal vectors are folded first. Sign
sketches tell which rows of a bucket have a partner at all; only those are sent with their vectors. Pairs are
compared within buckets, large buckets in pairs of blocks; a pair that meets in several tables counts
in the first. Pairs are never listed: each row gets its number of links and one link into its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, free_name, partitions, scratch

THRESHOLD, RECALL, WIDTH, SEED = 0.95, 0.998, 2.0, 20240229
#: Rows of crowds up to which their names are sent to all tasks; more are joined by their ids.
SMALL = 1 << 19
#: Rows of a bucket that are compared with each other at once; unrelated vectors that share a bucket.
BLOCK, CROWD = 1024, 256
#: Sign bits of a sketch, and by how many standard deviations two near vectors' bits may differ more than expected.
BITS, SPREAD = 128, 6.0
#: A bucket is heavy if it holds this many of the vectors that a hash takes, one of SAMPLED; rows of a crowd that are looked at together.
HEAVY, SAMPLED, CHUNK = 200, 64, 4096


def collision(distance: float, width: float) -> float:
    """The chance that one quantised projection of two points at this distance is equal."""
    if distance <= 0:
        return 1.0
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Projections for each table, and tables: about CROWD unrelated vectors share a bucket, near ones meet in some table."""
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width)
    k = max(4, math.ceil(math.log(max(n / CROWD, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(near**k, 1 - 1e-12))))


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys_of(x: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit key for each row and table."""
    rng = np.random.default_rng([seed, x.shape[1], k, tables])
    directions, shifts = rng.standard_normal((x.shape[1], k * tables)), rng.uniform(0, width, k * tables)
    odd = (rng.integers(0, 1 << 63, k * tables, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    cells = np.floor((x @ directions + shifts) / width).astype(np.int64).view(np.uint64)
    h = (cells * odd).reshape(len(x), tables, k).sum(axis=2, dtype=np.uint64)
    h += np.uint64(x.shape[1] * 0x9E3779B97F4A7C15 % (1 << 64))  # cells of other dimensions are no neighbours
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """The signs of random projections of each row, as BITS / 64 numbers."""
    directions = np.random.default_rng([seed, x.shape[1], BITS]).standard_normal((x.shape[1], BITS))
    return np.packbits(x @ directions > 0, axis=1).view(np.int64)


def most_bits(threshold: float) -> int:
    """How many sign bits of two vectors at the threshold differ at most, but with a chance of about one in a thousand million."""
    share = math.acos(threshold) / math.pi
    return min(BITS, math.ceil(BITS * share + SPREAD * math.sqrt(BITS * share * (1 - share))))


def _near(slots: DataFrame, most: int) -> DataFrame:
    """id, table, key, n: the rows of each bucket that have a partner there whose sketch is near, and how many those are; slots: table, key, id, sketch, crowd.

    Two rows of one crowd (-1: none) are no partners: they are compared elsewhere.
    """
    words = [F.get("sketch", F.lit(w)).alias(f"word{w}") for w in range(BITS // 64)]
    dealt = slots.select("table", "key", "id", "crowd", *words).repartition(partitions(slots.sparkSession), "table", "key").sortWithinPartitions("table", "key")

    def close(x: np.ndarray, crowd: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for start in range(0, len(x), 256):
            part = x[start : start + 256]
            apart = np.bitwise_count(part[:, 0, None] ^ x[None, :, 0])
            for w in range(1, x.shape[1]):
                apart += np.bitwise_count(part[:, w, None] ^ x[None, :, w])
            apart[np.arange(len(part)), np.arange(start, start + len(part))] = BITS + 1
            if (crowd[start : start + 256] >= 0).any():
                apart[(crowd[start : start + 256, None] == crowd[None, :]) & (crowd[None, :] >= 0)] = BITS + 1
            out[start : start + 256] = (apart <= most).any(axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last, out, size = None, [], 0

        def done() -> None:
            nonlocal size
            ids, bits, crowd = (np.concatenate(c) for c in zip(*held, strict=True))
            if len(ids) > 1:
                found = ids[close(bits, crowd)]
                if len(found):
                    out.append((found, last, len(found)))
                    size += len(found)

        def table() -> pa.RecordBatch:
            counts = [len(f) for f, _, _ in out]
            columns = [np.concatenate([f for f, _, _ in out]), *[np.repeat(v, counts) for v in ([k[0] for _, k, _ in out], [k[1] for _, k, _ in out], counts)]]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["id", "table", "key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tables, keys, ids, crowds = (batch.column(k).to_numpy() for k in range(4))
            bits = np.stack([batch.column(k).to_numpy() for k in range(4, 4 + BITS // 64)], axis=1).view(np.uint64)
            cuts = [0, *(np.flatnonzero((tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                key = (int(tables[a]), int(keys[a]))
                if key != last and held:
                    done()
                    held = []
                last = key
                held.append((ids[a:z], bits[a:z], crowds[a:z]))
            if size > 20_000:
                yield table()
                out, size = [], 0
        if held:
            done()
        if out:
            yield table()

    return dealt.mapInArrow(run, "id long, table int, key long, n long")


def _hashed(rows: DataFrame, k: int, tables: int, width: float, seed: int) -> DataFrame:
    """rows (id, copies, vector) with keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                lists = batch.column(2)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                out, signs = np.zeros((batch.num_rows, tables), np.int64), np.zeros((batch.num_rows, BITS // 64), np.int64)
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    x = unit(lists.take(pa.array(at)).flatten().to_numpy(), int(dim))
                    out[at], signs[at] = keys_of(x, k, tables, width, seed), sketches(x, seed)
                listed = [pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * c.shape[1], c.shape[1], dtype=np.int32)), pa.array(c.ravel())) for c in (out, signs)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *listed], ["id", "copies", "vector", "keys", "sketch"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, copies long, vector {kind}, keys array<long>, sketch array<long>")


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; root[i] is the least of i's set, before and after."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _group_links(table: int, ids: np.ndarray, copies: np.ndarray, side: np.ndarray, x: np.ndarray, keys: np.ndarray, crowd: np.ndarray, threshold: float, across: bool):
    """For the rows of a group that have a link: id, copies linked in this table first, and the smallest id of their linked set."""
    n = len(ids)
    links, root = np.zeros(n, np.int64), np.arange(n)
    touched = np.zeros(n, bool)
    order = np.argsort(ids, kind="stable")
    ids, copies, side, x, keys, crowd = ids[order], copies[order], side[order], x[order], keys[order], crowd[order]

    for start in range(0, n, 512):
        near = x[start : start + 512] @ x.T >= threshold
        i, j = np.nonzero(near)
        i += start
        keep = (j > i) & ((crowd[i] < 0) | (crowd[i] != crowd[j]))
        if across:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            first = (keys[a] == keys[b]).argmax(axis=1) == table
            np.add.at(links, a[first], copies[b[first]])
            np.add.at(links, b[first], copies[a[first]])
            touched[a] = touched[b] = True
            _join(root, a, b)
    at = np.flatnonzero(touched)
    return ids[at], links[at], ids[root[at]]


def _linked(members: DataFrame, threshold: float) -> DataFrame:
    """id, links, root; members: table, key, pa, pb (blocks compared), side (the row's block), id, copies, vector, keys."""
    spark = members.sparkSession
    group = ["table", "key", "pa", "pb"]
    dealt = members.select(*group, "side", "id", "copies", "vector", "keys", "crowd").repartition(partitions(spark), *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done(parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts).combine_chunks()
            if t.num_rows < 2:
                return None
            lists = t.column("vector").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            if (sizes != sizes[0]).any():
                # unequal dimensions share a key by chance only; each is compared among itself
                parts = [done(t.filter(pa.array(sizes == d)).to_batches()) for d in np.unique(sizes)]
                parts = [x for x in parts if x is not None]
                return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None
            x = unit(lists.flatten().to_numpy(), int(sizes[0]))
            keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            get = lambda c: t.column(c).to_numpy()
            return _group_links(int(get("table")[0]), get("id"), get("copies"), get("side"), x, keys, get("crowd"), threshold, bool(get("pa")[0] != get("pb")[0]))

        def table(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(3)], ["id", "links", "root"])

        out: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(4)]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                key = tuple(int(c[a]) for c in cols)
                if key != last and held:
                    if (found := done(held)) is not None and len(found[0]):
                        out.append(found)
                    held = []
                last = key
                held.append(batch.slice(a, z - a))
            if sum(len(f[0]) for f in out) > 20_000:
                yield table(out)
                out = []
        if held and (found := done(held)) is not None and len(found[0]):
            out.append(found)
        if out:
            yield table(out)

    return dealt.mapInArrow(run, "id long, links long, root long")


def _ball(x: np.ndarray, copies: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, float]:
    """A center, which rows lie within reach of it (an angle), and the greatest angle among them: the mean of the rows, then twice of those near it."""
    near = np.ones(len(x), bool)
    for _ in range(3):
        center = (x[near] * copies[near, None]).sum(axis=0)
        length = np.linalg.norm(center)
        if not length:
            return x[0], np.zeros(len(x), bool), 0.0
        center = center / length
        angle = np.arccos(np.clip(x @ center, -1, 1))
        near = angle <= reach
        if not near.any():
            return center, near, 0.0
    return center, near, float(angle[near].max())


def _crowds(crowded: DataFrame, hashed: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """id, links, root of all pairs within a crowd; crowded: id, crowd. hashed: id, copies, vector.

    A crowd is dealt into chunks. In each chunk most rows lie in a ball half as wide as a link, so all of them are linked; two balls
    are linked as wholes if their centers are near enough, and apart as wholes if far enough. Only rows outside their chunk's ball, and pairs of balls
    for which that does not decide, are compared row by row: tight crowds take time in proportion, not with its square.
    """
    spark = crowded.sparkSession
    theta, slack = math.acos(threshold), 1e-7
    sizes = crowded.groupBy("crowd").agg(F.count("*").alias("n"))
    rows = crowded.join(F.broadcast(sizes), "crowd").select("id", "crowd", F.pmod(F.xxhash64(F.lit(5), "id"), F.expr(f"n div {chunk} + 1")).alias("chunk"))  # a row for each crowd
    dealt = rows.join(hashed.select("id", "copies", F.col("vector").cast("array<double>").alias("vector")), "id").select("crowd", "chunk", "id", "copies", "vector")

    def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(keys)]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                key = tuple(int(c[a]) for c in cols)
                if key != last and held:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(batch.slice(a, z - a))
        if held:
            yield pa.Table.from_batches(held)

    def matrix(t: pa.Table) -> np.ndarray:
        return unit(t.column("vector").combine_chunks().flatten().to_numpy(), len(t.column("vector")[0]))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            x, ids, copies = matrix(t), t.column("id").to_numpy(), t.column("copies").to_numpy()
            center, near, radius = _ball(x, copies, theta / 2 - slack)
            n = len(ids) + 1
            # the rows, and one for the ball itself: the center, its least id, radius and size
            whole = [*ids.tolist(), int(ids[near].min()) if near.any() else -1]
            flat = pa.array(np.concatenate([x, center[None, :]]).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * x.shape[1], x.shape[1], dtype=np.int32)), flat)
            kind = pa.array([1 if k else 0 for k in near.tolist()] + [2], pa.int32())
            same = [pa.array([t.column(c)[0].as_py()] * n, pa.int64()) for c in ("crowd", "chunk")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(whole, pa.int64()), pa.array([*copies.tolist(), int(copies[near].sum())], pa.int64()), vectors, kind, pa.array([0.0] * (n - 1) + [radius])], ["crowd", "chunk", "id", "copies", "vector", "kind", "radius"])

    p = partitions(spark)
    kept = cut(dealt.repartition(p, "crowd", "chunk").sortWithinPartitions("crowd", "chunk").mapInArrow(balls, "crowd long, chunk long, id long, copies long, vector array<double>, kind int, radius double"), "balls")
    spheres = kept.where("kind = 2 and copies > 0").select("crowd", "chunk", "id", "copies", "vector", "radius")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all balls of a crowd: one for each chunk
        for t in grouped(batches, 1):
            t = t.sort_by("id")
            roots = np.arange(t.num_rows)
            c, ids, size, radius, number = matrix(t), t.column("id").to_numpy(), t.column("copies").to_numpy(), t.column("radius").to_numpy(), t.column("chunk").to_numpy()
            totals, later = [], []
            for start in range(0, len(c), 256):
                angle = np.arccos(np.clip(c[start : start + 256] @ c.T, -1, 1))
                most, least = angle + radius[start : start + 256, None] + radius, angle - radius[start : start + 256, None] - radius
                own = np.arange(start, start + len(angle))
                most[np.arange(len(own)), own] = least[np.arange(len(own)), own] = 9.0
                whole = most <= theta - slack
                open_ = ~whole & (least <= theta + slack)
                i, j = np.nonzero(whole)
                _join(roots, own[i], j)
                totals += (whole * size).sum(axis=1).tolist()
                later += [number[np.flatnonzero(row & (np.arange(len(c)) > k))].tolist() for k, row in zip(own.tolist(), open_, strict=True)]
            same = pa.array([t.column("crowd")[0].as_py()] * len(c), pa.int64())
            yield pa.RecordBatch.from_arrays([same, pa.array(number), pa.array(size + np.array(totals, np.int64)), pa.array(ids[roots]), pa.array(later, pa.list_(pa.int64()))], ["crowd", "chunk", "total", "root", "open"])

    told = cut(spheres.repartition(p, "crowd").sortWithinPartitions("crowd").mapInArrow(across, "crowd long, chunk long, total long, root long, open array<long>"), "spheres")
    inside = kept.where("kind = 1").join(told.drop("open"), ["crowd", "chunk"]).select("id", (F.col("total") - F.col("copies")).alias("links"), "root")
    # the edges that join balls: each ball's own least id with the least that it is linked with
    inside = inside.union(told.join(spheres.select("crowd", "chunk", F.col("id").alias("least")), ["crowd", "chunk"]).select("least", F.lit(0).cast("bigint"), "root"))

    # what is left: rows outside their ball against all chunks of their crowd, and pairs of balls that are open
    chunks_of = kept.where("kind = 2").select("crowd", F.col("chunk").alias("other"))
    lone = kept.where("kind = 0")
    blocks = lone.groupBy("crowd").agg(F.count("*").alias("lone"))
    block = F.pmod(F.xxhash64(F.lit(6), "id"), F.expr(f"lone div {chunk} + 1"))
    columns = ["crowd", "other", "part", "id", "copies", "vector", "kind"]
    asked = lone.join(F.broadcast(blocks), "crowd").withColumn("part", block).join(F.broadcast(chunks_of), "crowd").withColumn("kind", F.lit(-1)).select(*columns)  # a row for each chunk of a crowd
    there = kept.where("kind < 2").join(F.broadcast(blocks), "crowd").withColumn("other", F.col("chunk")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"lone div {chunk}")))).select(*columns)
    pairs = told.select("crowd", F.col("chunk").alias("other"), F.explode("open").alias("second"))
    ball = kept.where("kind = 1").select("crowd", F.col("chunk").alias("c"), "id", "copies", "vector")
    number = (-1 - F.col("second")).alias("part")  # open pairs have parts of their own, below zero
    first = pairs.join(ball.withColumnRenamed("c", "other"), ["crowd", "other"]).select("crowd", "other", number, "id", "copies", "vector", F.lit(-2).alias("kind"))
    second = pairs.join(ball.withColumnRenamed("c", "second"), ["crowd", "second"]).select("crowd", "other", number, "id", "copies", "vector", F.lit(2).alias("kind"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            t = t.sort_by("id")
            kind, ids, copies = (t.column(c).to_numpy() for c in ("kind", "id", "copies"))
            x = matrix(t)
            left, right = np.flatnonzero(kind < 0), np.flatnonzero(kind >= 0)
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for start in range(0, len(left), 512):
                i = left[start : start + 512]
                near = (x[i] @ x[right].T >= threshold) & (ids[i][:, None] != ids[right][None, :])
                links[i] += (near * copies[right]).sum(axis=1)
                # two rows outside their balls meet twice, once on each side, and count on the left only
                links[right] += ((near & (kind[right] > 0)[None, :]) * copies[i][:, None]).sum(axis=0)
                a, b = np.nonzero(near)
                _join(root, i[a], right[b])
            at = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])], ["id", "links", "root"])

    work = asked.union(there).union(first).union(second).repartition(p, "crowd", "other", "part").sortWithinPartitions("crowd", "other", "part")
    return inside.union(work.mapInArrow(rest, "id long, links long, root long"))


def classes(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, seed: int = SEED, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Rows are linked if the cosine of their vectors, in double precision, is at least the threshold; none below it are.
    A pair at the threshold is found with the chance `recall` (its sketches differ too much once in a thousand million), nearer pairs almost surely. component_id is the smallest
    vec_id reachable by links, itself included; kept tells whether it is the row's own. Vectors that are null, empty, zero or
    have null or non-finite components, and rows with a null vec_id, link with nothing; vectors of different
    lengths neither. Repeated rows count as copies of each other. An empty table gives an empty result.
    """
    v = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("vector"), F.xxhash64(F.lit(1), F.col(vector)).alias("ha"), F.xxhash64(F.lit(2), F.col(vector)).alias("hb"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    good = F.coalesce(F.forall("vector", fine) & F.exists("vector", lambda c: c != 0), F.lit(False)) & F.col("id").isNotNull()
    with scratch() as stay:
        folded, links, groups = _found(v, good, threshold, recall, width, seed, block, chunk)
        stay += [folded, links, groups]
    named = folded.join(links, "id", "left").join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    named = named.select("ha", "hb", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    ok = free_name("ok", [])
    # 128 bits of the vector stand for it, so that it need not be sent again
    out = v.select("id", "ha", "hb", good.alias(ok)).join(named.withColumn(ok, F.lit(True)), [ok, "ha", "hb"], "left")
    own_group = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), own_group.alias("component_id"), F.coalesce(own_group == F.col("id"), F.lit(True)).alias("kept"))


def _found(v: DataFrame, good: Column, threshold: float, recall: float, width: float, seed: int, block: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct vectors, the links of each, and the components of their links."""
    folded = cut(v.where(good).groupBy("vector", "ha", "hb").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", "vector", "ha", "hb"), "vectors")
    k, tables = plan(folded.count(), threshold, recall, width)
    hashed = cut(_hashed(folded.drop("ha", "hb"), k, tables, width, seed), "hashed")
    slots = hashed.select("id", "sketch", F.posexplode("keys").alias("table", "key"))
    # rows of buckets that hold many of a fixed share of vectors form crowds, which are compared by balls; in other buckets only rows with a near sketch go on
    some = slots.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SAMPLED)) == 0)
    heavy = cut(some.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY).select("table", "key"), "heavy")
    crowd = F.lit(-1).cast("bigint").alias("crowd")
    light, known, found = slots.select("*", crowd), hashed.select("*", crowd), None
    if heavy.limit(1).count():
        inside = cut(slots.select("id", "table", "key").join(F.broadcast(heavy), ["table", "key"]), "inside")  # tables / (HEAVY * SAMPLED) rows for each vector at most
        least = inside.groupBy("table", "key").agg(F.min("id").alias("least"))
        parted = components(inside.join(F.broadcast(least), ["table", "key"]).select(F.col("id").alias("a"), F.col("least").alias("b")))  # as many rows as heavy
        named = parted.select(F.col("node").alias("id"), F.col("component").alias("crowd"))
        told = F.broadcast(named) if named.limit(SMALL + 1).count() <= SMALL else named
        known = cut(hashed.join(told, "id", "left").withColumn("crowd", F.coalesce("crowd", F.lit(-1))), "crowded")
        light = known.select("id", "sketch", F.posexplode("keys").alias("table", "key"), "crowd").join(F.broadcast(heavy), ["table", "key"], "left_anti")
        found = cut(_crowds(named, hashed, threshold, chunk), "in_crowds")
    near = cut(_near(light, most_bits(threshold)), "near")
    parts = F.expr(f"cast(n div {block} as int) + 1")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    dealt = near.select("id", "table", "key", own.alias("side"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    members = dealt.select("id", "table", "key", F.least("side", "other").alias("pa"), F.greatest("side", "other").alias("pb"), "side").join(known.drop("sketch"), "id")
    linked = cut(_linked(members, threshold), "linked")
    found = linked if found is None else linked.union(found)
    links = cut(found.groupBy("id").agg(F.sum("links").alias("links")), "links")
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    return folded, links, groups


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), groups AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, g.component_id, e.vec_id = g.component_id AS kept
FROM embeddings e JOIN groups g ON g.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
