"""BPE encoding and decoding (operator 4): forced boundaries cut texts into fragments that are encoded apart.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge, so a text
may be cut between its two bytes: what the merges make of each side does not depend on the other.
ASCII white space is such a byte throughout, so texts are first cut there; what lies between is
normalised and split as the tokenizer file says and cut at the forced boundaries of its byte pairs.
Each fragment is encoded once per worker and kept; ids and decoded text are put together from them.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, append, free_name, per_worker

NAME = "word_bpe_49k.json"
#: Pieces and fragments that a worker keeps.
PIECES, FRAGMENTS = 60_000, 150_000
SUFFIX = "</w>"


def vocabulary(name: str = NAME) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a large binary column start in its data, and the end."""
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)


def lines(column: pa.Array) -> list[str]:
    """The strings of a column that has no line break in it."""
    if not len(column):
        return []
    ended = pc.binary_join_element_wise(column.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    at = offsets(ended)
    return ended.buffers()[2][int(at[0]) : int(at[-1]) - 1].to_pybytes().decode().split("\n")


def gather(values: pa.Array, at: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each pair of neighbours in bounds, the values at those places of `at` in one."""
    if not len(at):
        return pa.array([b""] * (len(bounds) - 1), pa.large_binary())
    taken = values.take(pa.array(at))
    ends = np.ascontiguousarray(offsets(taken)[bounds])
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), taken.buffers()[2]])


class Encoder:
    """encode(bytes) -> ids as little-endian unsigned 32-bit integers, equal to the tokenizers library without special tokens added."""

    #: Characters outside printable Latin-1, which the library itself normalises and splits.
    ODD = re.compile("[^\x21-\x7e\xa1-\xff]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # inside a word no symbol bears the suffix, so the same merges without it encode a fragment that ends none
        self.inner = models.BPE(vocab=self.vocab, merges=merges)
        self.last = self.tokenizer.model
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.mark = re.compile("|".join(re.escape(x[:2]) for x in self.added).encode()) if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.parts = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.table = {i: x for i, x in enumerate(self.letters)}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        code = {x: i for i, x in enumerate(self.letters)}
        self.joins = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token.removesuffix(SUFFIX)
            at = [code[c] for c in body if c in code]
            self.joins[at[:-1], at[1:]] = True
        # letters between which a cut is certain, as a set of two-letter texts
        self.apart = {self.letters[a] + self.letters[b] for a, b in zip(*np.nonzero(~self.joins), strict=True)}
        self.fragments = Words(self._fragment, FRAGMENTS)
        self.pieces = Words(self._piece, PIECES)
        # the same in bulk: words on lines, fragments between spaces; neither byte has its own letter then
        self.parted = regex.compile("(?:" + split["pattern"]["Regex"] + ")|\n").findall
        self.apart_from = "|".join(["[^\x21-\x7e\u00a1-\u00ff]", *sorted({re.escape(x[:2]) for x in self.added})])
        self.table_of_tokens = pa.array([(self.tokens.get(i, "") + " ").encode() for i in range(max(self.tokens) + 1)], pa.large_binary())
        self.held = self.joins.copy()
        self.held[10, :] = self.held[:, 10] = True
        self.spaced = {i: x for i, x in self.table.items() if i not in (10, 32)}
        self.bulk = []
        for m in (self.inner, self.last):
            t = Tokenizer(m)
            t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.bulk.append(t)
        self.known: tuple[dict[str, bytes], ...] = ({}, {})

    def _fragment(self, key: tuple[str, bool]) -> tuple[int, ...]:
        text, ends = key
        return tuple(t.id for t in (self.last if ends else self.inner).tokenize(text))

    def _fragments(self, wanted: pa.Array, ends: bool) -> pa.Array:
        """Ids of many distinct fragments, from one call of the library for all that are not kept."""
        kept = self.known[ends]
        names = lines(wanted)
        values = list(map(kept.get, names))
        new = [f for f, v in zip(names, values, strict=True) if v is None]
        if new:
            found = self.bulk[ends].encode("\n".join(new), add_special_tokens=False)
            stops = 4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(new)))
            raw = np.array(found.ids, "<u4").tobytes()
            ids = [raw[i:j] for i, j in zip([0, *stops.tolist()], stops.tolist(), strict=False)]
            kept.update(islice(zip(new, ids, strict=True), max(0, FRAGMENTS - len(kept))))
            more = iter(ids)
            values = [next(more) if v is None else v for v in values]
        return pa.array(values, pa.large_binary())

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of many distinct words, cut at forced boundaries in one go, fragments encoded apart and put together."""
        codes = np.frombuffer("\n".join(lines(words)).encode(), np.uint8)
        cuts = np.flatnonzero(~self.held[codes[:-1], codes[1:]]) + 1
        cut = np.insert(codes, cuts, 32)
        marks = cut[(cut == 10) | (cut == 32)]
        ends = np.append(marks == 10, True)
        fragments = pc.split_pattern(pa.array([cut.tobytes().decode("latin-1").translate(self.spaced).replace(" ", "\n")], pa.large_string()), "\n").flatten()
        at = np.empty(len(fragments), np.int64)
        parts, base = [], 0
        for which in (False, True):
            coded = pc.dictionary_encode(fragments.filter(pa.array(ends == which)))
            at[ends == which] = coded.indices.to_numpy() + base
            parts.append(self._fragments(coded.dictionary, which))
            base += len(coded.dictionary)
        return gather(pa.concat_arrays(parts), at, np.append(0, np.flatnonzero(ends) + 1))

    def _many(self, pieces: pa.Array) -> pa.Array:
        """Ids of many distinct pieces of plain letters."""
        if not len(pieces):
            return pa.array([], pa.large_binary())
        parts = pa.array(self.parted("\n".join(lines(pieces)).lower()), pa.large_string())
        breaks = pc.equal(parts, "\n").to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(parts.filter(pa.array(~breaks)))
        bounds = np.concatenate([[0], np.flatnonzero(breaks) - np.arange(len(pieces) - 1), [len(coded)]])
        return gather(self._words(coded.dictionary), coded.indices.to_numpy(), bounds)

    def all(self, texts: list[bytes | None]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of each text: distinct pieces are encoded together, and results are put in their places."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        flat, bounds = split.flatten(), split.offsets.to_numpy()
        filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(filled))[bounds]
        coded = pc.dictionary_encode(flat.filter(pa.array(filled)))
        pieces = coded.dictionary
        if not len(pieces):
            return [(b"", b"")] * len(texts)
        odd = pc.match_substring_regex(pieces, self.apart_from).to_numpy(zero_copy_only=False)
        values = pa.concat_arrays([self._many(pieces.filter(pa.array(~odd))), pa.array([self.pieces[p.encode()] for p in pieces.filter(pa.array(odd)).to_pylist()], pa.large_binary())])
        place = np.where(odd, np.cumsum(odd) - 1 + (~odd).sum(), np.cumsum(~odd) - 1)
        ids = gather(values, place[coded.indices.to_numpy()], bounds)
        ends = offsets(ids) // 4
        back = gather(self.table_of_tokens, np.frombuffer(ids.buffers()[2], "<u4", ends[-1]).astype(np.int64), ends)
        return [(i, b[:-1]) for i, b in zip(ids.to_pylist(), back.to_pylist(), strict=True)]

    def _word(self, letters: str) -> list[int]:
        """The ids of one word in byte letters, fragment by fragment."""
        out: list[int] = []
        start, apart, fragments = 0, self.apart, self.fragments
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] in apart:
                out += fragments[letters[start:i], False]
                start = i
        out += fragments[letters[start:], True]
        return out

    def _plain(self, text: str) -> list[int]:
        """The ids of a text without white space of ASCII and without added tokens."""
        if self.ODD.search(text):
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        else:
            words = self.parts(text.lower())
            if not text.isascii():
                words = [w.encode().decode("latin-1").translate(self.table) for w in words]
        out: list[int] = []
        for word in words:
            out += self._word(word)
        return out

    def _piece(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8")
        if self.mark is not None and self.mark.search(raw):
            ids: list[int] = []
            for part in self.special.split(text):
                ids += [self.added[part]] if part in self.added else self._plain(part) if part else []
        else:
            ids = self._plain(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text, little-endian, four bytes each."""
        return self.all([text])[0][0]

    def decode(self, ids: bytes) -> str:
        """What the library's decode gives for files without a decoder: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def both(self, text: bytes | None) -> tuple[bytes, bytes]:
        """Ids and decoded text in UTF-8 of one text."""
        return self.all([text])[0]


def encoder(path: str) -> Encoder:
    return per_worker(("bpe", path), partial(Encoder, path))


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    Null and empty texts have no tokens and the hashes of nothing. Very long texts are encoded whole;
    repeated rows each get their result; an empty table stays empty. If docs has a column of one of
    these names, the new one has an underscore before its name.
    """
    path = path or vocabulary()
    fields = [T.StructField(free_name(f.name, docs.columns), f.dataType) for f in [*FIELDS, *[T.StructField("ids", T.ArrayType(T.IntegerType()))][: int(ids)]]]

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        e = encoder(path)
        n, hashes, decoded, flat = [], [], [], []
        for found, back in e.all(texts):
            n.append(len(found) // 4)
            hashes.append(hashlib.sha256(found).hexdigest())
            decoded.append(hashlib.sha256(back).hexdigest())
            if ids:
                flat.append(found)
        out = [pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        if ids:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), "<i4"))))
        return out

    return append(docs, text, work, fields)


def decode(frame: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """frame with the text that its arrays of ids decode to; null for null, and ids that are null or not in the vocabulary are left out, as the library does."""
    path = path or vocabulary()
    out = free_name(out, frame.columns)
    at, names = frame.columns.index(ids), [*frame.columns, out]

    def run(batches):
        e = encoder(path)
        for batch in batches:
            texts = [None if x is None else " ".join([e.tokens[i] for i in x if i in e.tokens]) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(out, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text"))
    return encode(docs, ids=False).drop("text")
