"""Substring dedup (operator 7): Rabin-Karp hashes of every window of words, counted across documents.

Every window's 64-bit hash leaves its document together with doc_id and place, packed: entries are
sorted by hash, hashes stored as differences, and the byte planes of all three columns compressed, so
that a window takes about ten bytes instead of a row. The hashes are dealt into buckets by their top
bits; a task counts one bucket at a time. A window that also starts in a smaller document goes back to
its own document, where windows merge into maximal intervals of removed words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, as_bytes, cut, free_name, partitions, per_worker, slices

WINDOW = 50
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
WORDS_KEPT = 200_000
#: Buckets for each shuffle partition: a task holds the windows of one bucket at a time.
BUCKETS = 4
#: Words of text whose windows are sorted and packed at once.
PACK_CHARS = 16 << 20


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, 7)


def word_hashes(words: list[bytes]) -> np.ndarray:
    kept = per_worker("window words", partial(Words, _hash, WORDS_KEPT))
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of `window` hashes, from runs of doubling lengths, then mixed."""
    n = len(h) - window + 1
    acc, length = None, 0
    run, size = h, 1
    left = window
    while left:
        if left & 1:
            # what is put together so far, followed by a run of this size
            if acc is None:
                acc, length = run, size
            else:
                more = run[length:]
                keep = min(len(acc), len(more))
                acc, length = acc[:keep] * np.uint64(pow(BASE, size, 1 << 64)) + more[:keep], length + size
        left >>= 1
        if left:
            run = run[: len(run) - size] * np.uint64(pow(BASE, size, 1 << 64)) + run[size:]
            size *= 2
    x = acc[:n]
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def pack(h: np.ndarray, doc: np.ndarray, at: np.ndarray, squeeze) -> bytes:
    """Entries sorted by hash, as compressed byte planes."""
    delta = np.diff(h, prepend=np.uint64(0))
    return squeeze(planes(delta) + planes(doc) + planes(at))


def unpack(blob: bytes, n: int, expand) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = expand(blob)
    return np.cumsum(unplanes(raw, "<u8", n), dtype=np.uint64), unplanes(raw[8 * n :], "<i8", n), unplanes(raw[16 * n :], "<u4", n)


def packed_windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """bucket, n, blob; docs: id, text, base (the place of its first word). Documents with fewer words than a window, or without an id, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        hashes, ids, places, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            h, doc, at = np.concatenate(hashes), np.repeat([i for i, _ in ids], [n for _, n in ids]).astype(np.int64), np.concatenate(places)
            order = np.argsort(h)
            h, doc, at = h[order], doc[order], at[order]
            # bucket k holds the hashes from k * 2**64 / buckets
            edges = np.searchsorted(h, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64))
            spans = [(k, a, z) for k, (a, z) in enumerate(zip([0, *edges], [*edges, len(h)], strict=True)) if z > a]
            blobs = [pack(h[a:z], doc[a:z], at[a:z], squeeze) for _, a, z in spans]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int32()), pa.array([int(z - a) for _, a, z in spans], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                for i, text, low in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    if i is None or len(words) < window:
                        continue
                    h = rolling(word_hashes(words), window)
                    hashes.append(h)
                    ids.append((i, len(h)))
                    places.append(np.arange(low, low + len(h), dtype=np.uint32))
                    held += len(text)
                    if held >= PACK_CHARS:
                        yield out()
                        hashes, ids, places, held = [], [], [], 0
        if hashes:
            yield out()

    return docs.mapInArrow(run, "bucket int, n long, blob binary")


def slot_of(ids: np.ndarray, slots: int) -> np.ndarray:
    """What Spark's pmod(xxhash64(id), slots) gives."""
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in (i.to_bytes(8, "little", signed=True) for i in ids.tolist())), np.uint64, len(ids))
    return np.mod(h.view(np.int64), slots).astype(np.int32)


def repeated(blobs: DataFrame, slots: int) -> DataFrame:
    """slot, n, blob: the windows whose hash also occurs in a smaller document, as packed doc_ids and places by slots of documents."""
    p = partitions(blobs.sparkSession)
    dealt = blobs.repartitionById(p, F.col("bucket") % p).sortWithinPartitions("bucket")

    def found(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, doc, at = (np.concatenate(x) for x in zip(*entries, strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
        later = doc > least
        return doc[later], at[later]

    def rows(docs: list[np.ndarray], places: list[np.ndarray], squeeze) -> Iterator[pa.RecordBatch]:
        doc, at = np.concatenate(docs), np.concatenate(places)
        if not len(doc):
            return
        ids, which = np.unique(doc, return_inverse=True)
        slot = slot_of(ids, slots)[which]
        order = np.lexsort((doc, slot))
        doc, at, slot = doc[order], at[order], slot[order]
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
        packed = [squeeze(planes(doc[a:z]) + planes(at[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(slot[cuts[:-1]]), pa.array(np.diff(cuts).astype(np.int64)), pa.array(packed, pa.binary())], ["slot", "n", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        now, entries, docs, places, held = None, [], [], [], 0
        for batch in batches:
            for bucket, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and entries:
                    d, a = found(entries)
                    docs.append(d)
                    places.append(a)
                    held += len(d)
                    entries = []
                    if held > 1 << 21:
                        yield from rows(docs, places, squeeze)
                        docs, places, held = [], [], 0
                now = bucket
                entries.append(unpack(blob, n, expand))
        if entries:
            d, a = found(entries)
            docs.append(d)
            places.append(a)
        if docs:
            yield from rows(docs, places, squeeze)

    return dealt.mapInArrow(run, "slot int, n long, blob binary")


def intervals(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that windows at these places cover, ends exclusive."""
    at = np.unique(places).astype(np.int64)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.concatenate([[0], breaks + 1])].tolist(), (at[np.concatenate([breaks, [len(at) - 1]])] + window).tolist(), strict=True))


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))]


def _placed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str | None]:
    """Where rows with one doc_id have different texts, docs with a column that tells each text's first place: they lie one after another.

    As a rule there are none, and docs is given as it is.
    """
    two = [F.xxhash64(F.lit(1), F.col(text)).alias("ta"), F.xxhash64(F.lit(2), F.col(text)).alias("tb")]
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), *two, F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
    texts = rows.groupBy("id", "ta", "tb").agg(F.max("n").alias("n"))
    several = cut(texts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ta", "tb", "n"))).alias("x")).where(F.size("x") > 1), "texts_of_ids")
    if not several.limit(1).count():
        return docs, None
    # a text has no more words than bytes
    ends = F.transform("x", lambda t, i: F.struct(t["ta"].alias("ta"), t["tb"].alias("tb"), F.aggregate(F.slice("x", 1, i), F.lit(0).cast("bigint"), lambda a, y: a + F.shiftright(y["n"], 1) + 1).alias("base")))
    names = [free_name(n, docs.columns) for n in ("place_id", "place_a", "place_b", "place_base")]
    bases = several.select("id", F.explode(ends).alias("t")).select("id", "t.*").toDF(*names)
    on = (F.col(doc_id).cast("bigint") == F.col(names[0])) & (two[0] == F.col(names[1])) & (two[1] == F.col(names[2]))
    return docs.join(bases, on, "left").drop(*names[:3]).withColumn(names[3], F.coalesce(names[3], F.lit(0).cast("bigint"))), names[3]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """docs with n_words, n_removed, kept_text (kept words joined by one space) and removed (intervals of word places).

    Words are what lies between ASCII white space. A word goes if a window covering it has a word
    sequence that also starts in a document with a smaller doc_id. Null and empty texts have no words;
    a null doc_id has no windows and loses nothing; rows that repeat a doc_id are one document: they take no words
    from each other, and each loses those of its own text; an empty table stays empty. With digest,
    kept_sha256 takes the place of the last two.
    """
    spark = docs.sparkSession
    p = partitions(spark)
    docs, base = _placed(docs, doc_id, text)
    first = F.col(base) if base else F.lit(0).cast("bigint")
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), first.alias("base"))
    if base:
        narrow = narrow.dropDuplicates(["id", "base"])
        docs = docs.select(*[c for c in docs.columns if c != base], base)
    whole, docs = docs, docs.drop(base) if base else docs
    marks = repeated(packed_windows(narrow, window, BUCKETS * p), p)
    # documents and the marks of their slot meet in one task, marks first
    ident, slot, size, blob, last = (free_name(n, docs.columns) for n in ("mark_id", "mark_slot", "mark_n", "mark_blob", "mark_last"))
    key = F.col(doc_id).cast("bigint")
    own = F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.col(text))), F.lit(p)).cast("int")
    start = free_name("mark_base", docs.columns)
    left = whole.select(*docs.columns, key.alias(ident), own.alias(slot), first.alias(start), F.lit(None).cast("bigint").alias(size), F.lit(None).cast("binary").alias(blob), F.lit(1).alias(last))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
    right = marks.select(*blank, F.lit(None).cast("bigint").alias(ident), F.col("slot").alias(slot), F.lit(0).cast("bigint").alias(start), F.col("n").alias(size), F.col("blob").alias(blob), F.lit(0).alias(last))
    joined = left.union(right).repartitionById(p, F.col(slot)).sortWithinPartitions(last)
    fields = [*FIELDS[:2], T.StructField("kept_sha256", T.StringType())] if digest else FIELDS
    fields = [T.StructField(free_name(f.name, docs.columns), f.dataType) for f in fields]
    width, at, names = len(docs.columns), docs.columns.index(text), [*docs.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        marked: list[tuple[np.ndarray, np.ndarray]] = []
        index: dict[int, tuple[int, int]] | None = None
        places = np.zeros(0, np.uint32)
        for batch in batches:
            kinds = batch.column(width + 5).to_numpy()
            first = int(np.searchsorted(kinds, 1))
            for n, raw in zip(batch.column(width + 3).slice(0, first).to_pylist(), batch.column(width + 4).slice(0, first).to_pylist(), strict=True):
                raw = expand(raw)
                marked.append((unplanes(raw, "<i8", n), unplanes(raw[8 * n :], "<u4", n)))
            if first == len(kinds):
                continue
            if index is None:
                index = {}
                if marked:
                    doc, places = (np.concatenate(x) for x in zip(*marked, strict=True))
                    order = np.argsort(doc, kind="stable")
                    doc, places = doc[order], places[order]
                    cuts = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
                    index = {int(doc[a]): (a, z) for a, z in zip(cuts, cuts[1:], strict=False)}
                    marked = []
            for part in slices(batch.slice(first), text):
                total, gone, kept, cut = [], [], [], []
                for raw, i, low in zip(as_bytes(part.column(at)), part.column(width).to_pylist(), part.column(width + 2).to_pylist(), strict=True):
                    words = (raw or b"").split()
                    total.append(len(words))
                    a, z = index.get(i, (0, 0))
                    own = places[a:z].astype(np.int64) - low
                    spans = intervals(own[(own >= 0) & (own + window <= len(words))], window)
                    removed = 0
                    for a, z in reversed(spans):
                        del words[a:z]
                        removed += z - a
                    gone.append(removed)
                    left = b" ".join(words)
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
                    cut.append([list(x) for x in spans])
                arrays = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
                if not digest:
                    arrays.append(pa.array(cut, pa.list_(pa.list_(pa.int64()))))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *arrays], names)

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, digest=True).drop("text")


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM words, unnest(range(1, len(w) - 48)) t(i)
), firsts AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > least
), places AS (
  SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) t(i)
), kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.p GROUP BY ALL
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
