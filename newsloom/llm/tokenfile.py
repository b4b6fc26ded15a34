"""Token-ID / binary output (operator 10): bit-plane shuffled, compressed chunks of ids with an index.

A segment is one self-contained byte string that holds whole documents:

    header   magic "NLTF", version 2, plane kind (0 byte planes, 1 bit planes), two bytes of zero, ids in the
             segment (u64), ids in a chunk (u32), chunks (u32), documents (u32), those of them, first, without a doc_id (u32)
    index    for each chunk: offset of its planes in the body (u64), ids (u32), and for each plane its size (u32)
    docs     for each document: its doc_id (i64) and ids (u32)
    body     planes: of each chunk's ids as unsigned 32-bit integers, transposed to byte or bit planes,
             each plane compressed with zstandard; a plane of size 0 is all zeros

All numbers are little-endian. Segments lie in the rows of a Parquet table (shard, segment, ahead, n_ids, blob; ahead counts the ids of
the shard before the segment), as executors can write that to any store that Spark can. Ids run in ascending
doc_id order over shards and segments. A chunk can be read alone by the index.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, gather, vocabulary
from .common import as_bytes, cut, partitions, per_worker, slices

NAME, END = "byte_bpe_50k.json", 0
MAGIC, VERSION = b"NLTF", 2
HEAD = struct.Struct("<4sBBHQIIII")
#: Ids in a chunk, and in a segment at least, unless documents end.
CHUNK, SEGMENT = 1 << 15, 1 << 19
#: Words, and first pieces of texts, that a worker keeps; characters of text whose pieces are looked up at once.
WORDS, FIRSTS, BATCH = 400_000, 50_000, 16 << 20
#: How byte-level tokenizers split texts into words (a fixed value), and white space among the letters of Latin scripts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0]"
SEGMENTS = ["shard", "segment", "ahead", "n_ids", "blob"]


def shuffle(ids: np.ndarray, bit: bool) -> list[bytes]:
    """The byte or bit planes of ids, lowest first."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bit:
        return [p.tobytes() for p in planes]
    return [np.packbits(p >> np.uint8(k) & np.uint8(1)).tobytes() for p in planes for k in range(8)]


def unshuffle(planes: list[bytes], n: int, bit: bool) -> np.ndarray:
    if bit:
        rows = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) if p else np.zeros(n, np.uint8) for p in planes]
        rows = [sum(rows[8 * b + k] << np.uint8(k) for k in range(8)) for b in range(4)]
    else:
        rows = [np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(rows, axis=1).astype(np.uint8)).view("<u4").ravel()


def write_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, chunk: int = CHUNK, bit: bool = False, level: int = 1) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level).compress
    index, body, offset = [], [], 0
    for start in range(0, len(ids), chunk):
        part = ids[start : start + chunk]
        packed = [squeeze(p) if any_ else b"" for p in shuffle(part, bit) for any_ in [p.strip(b"\0") != b""]]
        index.append(struct.pack("<QI", offset, len(part)) + np.array([len(p) for p in packed], "<u4").tobytes())
        body += packed
        offset += sum(map(len, packed))
    docs = np.zeros(len(doc_ids), np.dtype([("i", "<i8"), ("n", "<u4")]))
    nameless = doc_ids.count(None)
    docs["i"], docs["n"] = [0] * nameless + doc_ids[nameless:], counts
    return b"".join([HEAD.pack(MAGIC, VERSION, int(bit), 0, len(ids), chunk, len(index), len(doc_ids), nameless), *index, docs.tobytes(), *body])


class Segment:
    """A segment's index; ids are read chunk by chunk."""

    def __init__(self, raw: bytes):
        magic, version, bit, _, self.n, self.chunk, chunks, docs, self.nameless = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        self.raw, self.bit, planes = raw, bool(bit), 32 if bit else 4
        kind = np.dtype([("at", "<u8"), ("n", "<u4"), ("size", "<u4", (planes,))])
        self.index = np.frombuffer(raw, kind, chunks, HEAD.size)
        at = HEAD.size + kind.itemsize * chunks
        found = np.frombuffer(raw, np.dtype([("i", "<i8"), ("n", "<u4")]), docs, at)
        self.doc_ids, self.counts = found["i"].astype(np.int64), found["n"].astype(np.int64)
        self.body = at + 12 * docs
        self.expand = zstandard.ZstdDecompressor().decompress

    def read_chunk(self, k: int) -> np.ndarray:
        entry = self.index[k]
        at, planes = self.body + int(entry["at"]), []
        for size in entry["size"].tolist():
            planes.append(self.expand(self.raw[at : at + size]) if size else b"")
            at += size
        return unshuffle(planes, int(entry["n"]), self.bit)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.read_chunk(k) for k in range(len(self.index))]) if len(self.index) else np.zeros(0, "<u4")

    def names(self) -> pa.Array:
        """The doc_id of each document, null for those without one."""
        return pa.array(self.doc_ids, mask=np.arange(len(self.doc_ids)) < self.nameless)


class Encoder:
    """Ids of texts by the tokenizers library, which encodes each distinct piece between single spaces once.

    The file's split never joins a space to what stands before it, so a text may be cut before each
    space that has something other than white space on one side. A batch is cut in one go, its distinct pieces
    are split into words as the library does, distinct words not seen before are encoded by its model, and
    the ids of all texts are gathered from them.
    """

    #: A space between white space, where a cut would change the split.
    INNER = re.compile(r"\s \s")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Pieces that the library encodes alone: with white space at an end, letters beyond Latin, or an added token.
        self.odd = "|".join([f"^$|^{BLANK}|{BLANK}$|[^\\x00-\\x{{24f}}]", *added])
        self.split = regex.compile(SPLIT).findall
        self.letters = dict(enumerate(byte_letters()))
        #: Ids are kept as narrow as the vocabulary allows.
        self.kind = "<u2" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], self.kind).tobytes()

    def _learn(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, each after a space: all are split into words in one go, and the library's model encodes distinct words."""
        odd = pc.match_substring_regex(pieces, self.odd).to_numpy(zero_copy_only=False)
        alone = [self._ids(" " + p).tobytes() for p in pieces.filter(pa.array(odd)).to_pylist()]
        plain = pieces.filter(pa.array(~odd))
        found = []
        if len(plain):
            split = pa.array(self.split(" " + " ".join(plain.to_pylist())), pa.large_string())
            coded = pc.dictionary_encode(split)
            # a space begins a piece's first word, and no other word
            at = coded.indices.to_numpy()
            starts = np.flatnonzero(pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)[at])
            if len(starts) != len(plain):
                raise ValueError("words do not begin where pieces do")
            values = self._known(coded.dictionary.to_pylist(), self.words, WORDS, lambda new: map(self._word, new))
            found = [gather(pa.array(values, pa.large_binary()), at, np.append(starts, len(at)))]
        place = np.where(odd, np.cumsum(odd) - 1, np.cumsum(~odd) - 1 + len(alone))
        return pa.concat_arrays([pa.array(alone, pa.large_binary()), *found]).take(pa.array(place))

    @staticmethod
    def _known(names: list[str], kept: dict[str, bytes], most: int, learn) -> list[bytes]:
        """The ids of distinct names, from those kept and, for the others, from one call of learn."""
        values = list(map(kept.get, names))
        fresh = [p for p, v in zip(names, values, strict=True) if v is None]
        if fresh:
            new = list(learn(fresh))
            kept.update(islice(zip(fresh, new, strict=True), max(0, most - len(kept))))
            more = iter(new)
            values = [next(more) if v is None else v for v in values]
        return values

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as bytes of the kind of this encoder; null has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = [i for i, t in enumerate(texts.to_pylist()) if self.INNER.search(t)]
        if whole:
            alone = {i: self._ids(texts[i].as_py()).tobytes() for i in whole}
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), texts)
        split = pc.split_pattern(texts, " ")
        flat, bounds = split.flatten(), np.asarray(split.offsets, np.int64)
        rest = np.ones(len(flat), bool)
        rest[bounds[:-1]] = False
        first, later = pc.dictionary_encode(flat.take(pa.array(bounds[:-1]))), pc.dictionary_encode(flat.filter(pa.array(rest)))
        begin = self._known(first.dictionary.to_pylist(), self.firsts, FIRSTS, lambda new: [self._ids(p).tobytes() for p in new])
        inner = self._learn(later.dictionary)
        at = np.empty(len(flat), np.int64)
        at[bounds[:-1]] = first.indices.to_numpy()
        at[rest] = later.indices.to_numpy().astype(np.int64) + len(begin)
        out = gather(pa.concat_arrays([pa.array(begin, pa.large_binary()), inner]), at, bounds).to_pylist()
        if whole:
            for i, ids in alone.items():
                out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    return per_worker(("token file", path), partial(Encoder, path))


def write(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int | None = END, bit: bool = False) -> DataFrame:
    """Encode the texts and write them to the shared folder; gives the table of segments as read back: SEGMENTS.

    Documents run in ascending doc_id order, with the id `end` after each. Null and empty texts have only that id. A document
    is never split between segments, so a very long text makes a long segment. Rows with a null doc_id come first;
    rows that share one follow one another in any order. An empty table gives no segment.
    """
    spark = docs.sparkSession
    path = path or vocabulary(NAME)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    shards = max(1, partitions(spark))
    # one number for each shard
    bounds = rows.select("id").approxQuantile("id", [k / shards for k in range(1, shards)], 0.2 / shards) if shards > 1 else []
    bounds = np.unique(np.array(bounds, np.float64))
    shared = bounds.tolist()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, edges = encoder(path), np.array(shared)
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                ids = part.column(0)
                found = e.batch(part.column(1))
                shard = np.searchsorted(edges, ids.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(), side="right").astype(np.int32)
                if end is not None:
                    tail = np.array([end], e.kind).tobytes()
                    found = [x + tail for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(found, pa.binary())], ["shard", "id", "ids"])

    def write_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        keys, counts, parts, held, now, number, ahead = [], [], [], 0, None, 0, 0

        def segment() -> pa.RecordBatch:
            blob = write_segment(keys, counts, np.concatenate(parts), bit=bit)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([number], pa.int32()), pa.array([ahead], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], SEGMENTS)

        for batch in batches:
            for shard, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                if keys and (shard != now or held >= SEGMENT):
                    yield segment()
                    number, ahead = (number + 1, ahead + held) if shard == now else (0, 0)
                    keys, counts, parts, held = [], [], [], 0
                now = shard
                ids = np.frombuffer(raw, kind)
                keys.append(key)
                counts.append(len(ids))
                parts.append(ids)
                held += len(ids)
        if keys:
            yield segment()

    coded = rows.mapInArrow(encode, "shard int, id long, ids binary")
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "id")
    return cut(dealt.mapInArrow(write_all, "shard int, segment int, ahead long, n_ids long, blob binary"), "tokens")


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array of int) of a table of segments."""
    return _read(segments, "ids array<int>", lambda ids, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))


def digest(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a table of segments."""

    def crc(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.int64())

    return _read(segments, "ids_crc32 long", crc)


def _read(segments: DataFrame, field: str, make) -> DataFrame:
    spark = segments.sparkSession
    # one row for each shard: a running sum over them; a segment knows what its shard has before it
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    base, before = [], 0
    for shard, n in sorted((r["shard"], r["n"]) for r in totals):
        base.append((shard, before))
        before += n
    bases = F.broadcast(spark.createDataFrame(base, "shard int, base long"))  # as many rows as there are shards
    placed = segments.join(bases, "shard").select((F.col("base") + F.col("ahead")).alias("first"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Segment(blob)
                ends = np.concatenate([[0], np.cumsum(s.counts)])
                yield pa.RecordBatch.from_arrays([s.names(), pa.array(first + ends[:-1]), pa.array(s.counts), make(s.ids(), ends)], ["doc_id", "start", "n_tokens", field.split()[0]])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
