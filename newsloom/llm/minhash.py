"""MinHash near-dedup (operator 9): circulant MinHash, banding, exact Jaccard similarity.

Two permutations of the 64-bit shingle hashes generate all coordinates of a signature: the first is
applied once, the second after a circular shift by the coordinate's number. Bands of coordinates
propose candidates; a link counts only if the full sets of shingles confirm it. Exact copies are
folded first, so a group of copies of any size is one row in what follows.

Candidates are the pairs that share a bucket. They are never listed in full: each member of a bucket
is compared with the bucket's smallest document, which settles most of them, and then, where a bucket
still has several components, the members outside the commonest with all members, in blocks of bounded
size. As components only need one chain of links, pairs already in one component are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_bytes, components, cut, free_name, over_texts, partitions, per_worker, scratch

WORDS_KEPT = 120_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Members that share one copy of a bucket's smallest document; rows of a set of centers and of a block of members.
SHARE, BLOCK = 64, 256
#: Documents of buckets with common members that are compared as one group.
TOGETHER = 1 << 14


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _words() -> Words:
    return per_worker("minhash words", partial(Words, _hash, WORDS_KEPT))


def mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = x * np.uint64(a)
    x ^= x >> np.uint64(32)
    x *= np.uint64(b)
    x ^= x >> np.uint64(29)
    return x


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, lower-cased in ASCII; words are what lies between ASCII white space."""
    words = (text or b"").lower().split()
    return np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of runs of `size` words; of the whole sequence if it is shorter; none without words."""
    if not len(h):
        return h
    if len(h) < size:
        acc = np.uint64(len(h))
        for x in h:
            acc = mix(np.array([acc ^ x]), 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[0]
        return np.array([acc], np.uint64)
    n = len(h) - size + 1
    acc = h[:n].copy()
    for k in range(1, size):
        acc *= MULTIPLIER
        acc += h[k : k + n]
    return np.unique(mix(acc, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Circulant:
    """Signatures of sets of 64-bit hashes: coordinate k is the least value of pi(sigma(x) + k * step)."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.shifts = np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        self.salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)

    def signatures(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each of the sets that lie one after another in x and begin at starts; none is empty."""
        s = mix(x, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
        a, b, c = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
        out = np.empty((len(starts), len(self.shifts)), np.uint64)
        y, t = np.empty_like(s), np.empty_like(s)
        for k, shift in enumerate(self.shifts):
            np.add(s, shift, out=y)
            np.multiply(y, a, out=y)
            np.right_shift(y, c, out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, b, out=y)
            out[:, k] = np.minimum.reduceat(y, starts)
        return out

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        """One hash for each row and band."""
        acc = np.tile(self.salt, (len(signature), 1))
        parts = signature.reshape(len(signature), self.bands, self.rows)
        for r in range(self.rows):
            acc = mix(acc ^ parts[:, :, r], 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
        return acc


#: Values that are permuted at once, so that they stay in the processor's cache; a larger set is a tile of its own.
TILE = 8192


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, n (size of the set), ta, tb (hashes of the text), fa, fb (128 bits of the word sequence), bands (array of long; null for an empty set)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        c = Circulant(bands, rows)
        n, fa, fb, keys = [], [], [], np.zeros((part.num_rows, bands), np.uint64)
        tile, rows_of, held = [], [], 0

        def flush() -> None:
            if tile:
                starts = np.cumsum([0, *map(len, tile[:-1])])
                keys[rows_of] = c.buckets(c.signatures(np.concatenate(tile), starts))

        for i, t in enumerate(as_bytes(part.column(1))):
            h = word_hashes(t)
            x = shingles(h, size)
            n.append(len(x))
            sequence = xxhash.xxh3_128_intdigest(h.tobytes())
            fa.append((sequence >> 64) - (1 << 63))
            fb.append((sequence & ((1 << 64) - 1)) - (1 << 63))
            if len(x):
                tile.append(x)
                rows_of.append(i)
                held += len(x)
                if held >= TILE:
                    flush()
                    tile, rows_of, held = [], [], 0
        flush()
        n = np.array(n, np.int64)
        flat = pa.array(keys.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (part.num_rows + 1) * bands, bands, dtype=np.int32)), flat, mask=pa.array(n == 0))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n), part.column(2), part.column(3), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), lists], ["id", "n", "ta", "tb", "fa", "fb", "bands"])

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(F.lit(1), F.col(text)).alias("ta"), F.xxhash64(F.lit(2), F.col(text)).alias("tb"))
    return over_texts(narrow, "text", work, "id long, n long, ta long, tb long, fa long, fb long, bands array<long>")


def _compare(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links. groups: g (array of long, the group's key), center (whether the row is one to compare with), id, text,
    label, bands, band.

    Within a group each row is compared with the centers that share a band with it (in any case if bands is null) and have
    another label; labels that a link joins count as one from then on. A row with a band is only compared with
    centers whose first shared band that is.
    """
    p = partitions(groups.sparkSession)
    names = ["g", "center", "id", "label", "band", "bands", "text"]
    dealt = groups.select(*names).repartition(p, "g").sortWithinPartitions("g", F.col("center").desc(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centers, matrix, root = None, [], None, {}

        def top(x):
            while (up := root.get(x, x)) != x:
                x = up
            return x

        for batch in batches:
            a, b = [], []
            keys, is_center, ids, labels, band, bands = (batch.column(k).to_pylist() for k in range(6))
            texts = as_bytes(batch.column(6))
            for i, key in enumerate(keys):
                if key != now:
                    now, centers, matrix, root = key, [], None, {}
                own = None if bands[i] is None else np.array(bands[i], np.int64)
                near = range(len(centers))
                if own is not None and centers:
                    if matrix is None or len(matrix) != len(centers):
                        matrix = np.array([c[2] for c in centers], np.int64)
                    same = matrix == own
                    near = np.flatnonzero(same.any(axis=1) if band[i] is None else same[:, band[i]] & (same.argmax(axis=1) == band[i])).tolist()
                x = None
                for k in near:
                    other, label, _, y = centers[k]
                    if other == ids[i] or top(label) == top(labels[i]):
                        continue
                    if x is None:
                        x = shingles(word_hashes(texts[i]), size)
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        a.append(ids[i])
                        b.append(other)
                        root[top(labels[i])] = top(label)
                if is_center[i]:
                    centers.append((ids[i], labels[i], bands[i], shingles(word_hashes(texts[i]), size) if x is None else x))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _rest(named: DataFrame) -> DataFrame:
    """Groups that compare, in buckets with several components, the members outside the commonest with all members.

    named: id, bands, band, bucket, label. Open buckets that share members are taken together as one group of distinct
    documents if it has at most TOGETHER; larger ones bucket by bucket. Sets of centers and blocks of members are
    BLOCK rows large, so the rows of a group are sent once for each set.
    """
    sizes = named.groupBy("band", "bucket", "label").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    heads = sizes.groupBy("band", "bucket").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("head"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("odd"), F.min("least").alias("first"))
    open_ = cut(heads.where("odd > 0"), "open")
    left = cut(named.join(open_, ["band", "bucket"]), "open_members")
    parts = components(left.select(F.col("id").alias("a"), F.col("first").alias("b")))
    placed = left.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id").withColumn("part", F.coalesce("part", "id"))
    placed = cut(placed, "placed")
    docs = placed.groupBy("part", "id").agg(F.first("bands").alias("bands"), F.first("label").alias("label"))
    by = docs.groupBy("part", "label").agg(F.count("*").alias("n")).groupBy("part")
    whole = cut(by.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("head"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("odd")), "parts")
    small = cut(docs, "part_members").join(whole.where(F.col("members") <= TOGETHER), "part")
    none = F.lit(None).cast("int")
    small = small.select("id", "bands", none.alias("band"), "label", "head", "members", "odd", F.array(F.col("part"), F.lit(-1).cast("bigint")).alias("of"))
    large = placed.join(whole.where(F.col("members") > TOGETHER).select("part"), "part", "left_semi")
    large = large.select("id", "bands", "band", "label", "head", "members", "odd", F.array(F.col("band").cast("bigint"), F.col("bucket")).alias("of"))
    both = small.union(large)
    sets, blocks = F.expr(f"odd div {BLOCK} + 1"), F.expr(f"members div {BLOCK} + 1")
    own_set, own_block = F.pmod(F.xxhash64("id"), sets), F.pmod(F.xxhash64(F.lit(1), "id"), blocks)
    group = lambda x, y: F.concat(F.col("of"), F.array(x, y))
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    keep = ["id", "bands", "band", "label"]
    rest = both.select(*keep, F.explode(F.transform(numbers(sets), lambda x: group(x, own_block))).alias("g"), F.lit(False).alias("center"))
    mids = both.where("label <> head").select(*keep, F.explode(F.transform(numbers(blocks), lambda y: group(own_set, y))).alias("g"), F.lit(True).alias("center"))
    return cut(rest.union(mids), "rest")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, size: int = 5, bands: int = 20, rows: int = 4, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; with texts, also two hashes of the text.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of shingles; component_id
    is the smallest doc_id reachable by links and kept tells whether it is the row's own. Documents
    with fewer words than a shingle have their whole sequence as their set; without words, or with a null
    text, the set is empty and nothing is linked. Rows that share a doc_id stand for one document, but each is kept
    by its own text; a null doc_id is in no component (component_id null) and kept. An empty table gives an empty result.
    """
    with scratch() as stay:
        signed, folded, label = _linked(docs, doc_id, text, percent, size, bands, rows)
        stay += [signed, folded, label]
    named = folded.join(label.select(F.col("node").alias("id"), "component"), "id", "left").select("fa", "fb", F.coalesce("component", "id").alias("component"))
    out = signed.join(named, ["fa", "fb"], "left")
    found = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    more = ["ta", "tb"] if texts else []
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"), *more)


def _linked(docs: DataFrame, doc_id: str, text: str, percent: int, size: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the distinct word sequences among them, and the components of their links."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = cut(signatures(docs, doc_id, text, size, bands, rows), "signatures")
    some = signed.where("n > 0 and id is not null")
    folded = cut(some.groupBy("fa", "fb").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "folded")
    slots = folded.select("id", "bands", F.posexplode("bands").alias("band", "bucket"))
    shared = cut(slots.groupBy("band", "bucket").agg(F.min("id").alias("center"), F.count("*").alias("members")).where("members > 1"), "buckets")
    member = cut(slots.join(shared, ["band", "bucket"]).select("id", "bands", "band", "bucket", "center", "members"), "members")

    # first each member against its bucket's smallest document
    pairs = cut(member.where("id <> center").select("id", "center").distinct(), "pairs")
    many = pairs.groupBy("center").agg(F.count("*").alias("n"))
    salts = many.select("center", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"n div {SHARE}"))).alias("salt"), "n")
    spread = pairs.join(cut(many, "centers").select("center", "n"), "center").select("id", F.array("center", F.pmod(F.xxhash64("id"), F.expr(f"n div {SHARE} + 1"))).alias("g"))
    asked = spread.select("g", "id", F.lit(False).alias("c")).union(salts.select(F.array("center", "salt"), F.col("center"), F.lit(True)))
    blank = {"band": F.lit(None).cast("int"), "bands": F.lit(None).cast("array<bigint>")}
    # each row is a label of its own: a link to the center settles no other member of the group
    first = asked.join(texts, "id").select("g", F.col("c").alias("center"), "id", "text", F.col("id").alias("label"), blank["band"].alias("band"), blank["bands"].alias("bands"))
    links = cut(_compare(first, size, percent), "links")

    # then, in buckets where that left several components, the members outside the center's with all members
    label = components(links)
    several = member.where("members > 2").select("id", "bands", "band", "bucket")
    named = several.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    groups = _rest(cut(named, "named"))
    if groups.limit(1).count():
        links = cut(links.union(_compare(groups.join(texts, "id"), size, percent)), "links")
        label = components(links)
    return signed, folded, label


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs whose document is the smallest of its group; rows with a null doc_id all stay.

    Of rows with one doc_id and text, one stays. Rows with one doc_id and different texts are judged each by its own text, so
    that no text is lost. Null and empty texts link with nothing and stay; an empty table stays empty.
    """
    a, b = free_name("text_a", docs.columns), free_name("text_b", docs.columns)
    keyed = docs.withColumns({a: F.xxhash64(F.lit(1), F.col(text)), b: F.xxhash64(F.lit(2), F.col(text))})
    found = classes(docs, doc_id, text, percent, texts=True).where("kept and doc_id is not null")
    kept = found.select(F.col("doc_id").alias(name := free_name("kept_id", keyed.columns)), F.col("ta").alias(x := free_name("kept_a", keyed.columns)), F.col("tb").alias(y := free_name("kept_b", keyed.columns)))
    one = keyed.join(kept, (F.col(doc_id) == F.col(name)) & (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_semi").dropDuplicates([doc_id, a, b])
    return one.drop(a, b).unionByName(docs.where(F.col(doc_id).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), each_one AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each_one a JOIN each_one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b WHERE 100 * n >= 85 * (len(s.s) + len(t.s) - n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""
