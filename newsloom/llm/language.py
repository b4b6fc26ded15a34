"""Language ID (operator 1): scripts narrow the candidates, per-word scores and a Viterbi path with a switching penalty label spans.

A word's score for a language is the log probability of its letter trigrams under counts learned from
labelled documents, relative to the best candidate. The path through a document's words may switch
language at a fixed cost. Where the one-language path is provably the best (no stretch of words gains
more than a switch costs) it is taken at once; other documents go through the full recursion.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, as_bytes, free_name, per_worker, slices

#: Labelled documents that training reads at most, for each language.
SAMPLE = 1500
#: Cost of a switch, the most that one word may speak against a language, and the additive smoothing.
PENALTY, WORST, SMOOTH = 12.0, 10.0, 0.3
#: Share of a language's letters from which a script counts as one of its scripts.
SCRIPT_SHARE = 0.01
BEGIN, END = ord("^"), ord("$")
UNKNOWN = "und"
WORDS_KEPT = 150_000
#: First code points of scripts; a letter belongs to the last one that is not above it.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other")]
_FIRST, _NAME = [a for a, _ in SCRIPTS], [b for _, b in SCRIPTS]


def script(c: str) -> str:
    from bisect import bisect_right

    return _NAME[bisect_right(_FIRST, ord(c)) - 1]


def letters(word: str) -> str:
    """A word's letters, lower-cased."""
    return word.lower() if word.isalpha() else "".join([c for c in word if c.isalpha()]).lower()


def grams(word: str) -> list[str]:
    """The trigrams of a word of letters with its ends marked."""
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> dict:
    """A model of the languages that docs are labelled with, from at most `sample` of the documents of each.

    The documents are chosen by a hash of the key, so the choice is the same wherever rows lie. Rows with a null text or
    label teach nothing. Only counts of trigrams and scripts leave the executors.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # a threshold on the hash that leaves about the sample's size of each language
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    draw = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1 << 30, (1 << 30) * sample // n + 1))]) if sizes else F.create_map(F.lit(""), F.lit(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch, "text"):
                for raw, name in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    words[name].update(raw.decode().split())
                if sum(map(len, words.values())) > 200_000:
                    yield table(words)
                    words = defaultdict(Counter)
        yield table(words)

    def table(words: dict[str, Counter]) -> pa.RecordBatch:
        found: dict[tuple[str, str], int] = Counter()
        for name, counted in words.items():
            for word, n in counted.items():
                if low := letters(word):
                    if low.isascii():
                        found[name, "=latin"] += n * len(low)
                    else:
                        for c in low:
                            found[name, "=" + script(c)] += n
                    for g in grams(low):
                        found[name, g] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    counted = rows.where(draw < limit[F.col("lang")]).select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    names = sorted(sizes)
    by = defaultdict(lambda: [0] * len(names))
    for r in counted.collect():  # bounded by the sample
        by[r["gram"]][names.index(r["lang"])] = r["n"]
    return fitted(names, by)


def fitted(names: list[str], by: dict[str, list[int]]) -> dict:
    kinds = {g[1:]: n for g, n in by.items() if len(g) > 1 and g[0] == "=" and g[1:] in set(_NAME)}
    seen = {g: n for g, n in by.items() if g[0] != "=" and sum(n) > 1}
    total = [sum(n[i] for n in seen.values()) for i in range(len(names))]
    all_letters = [max(1, sum(n[i] for n in kinds.values())) for i in range(len(names))]
    size = len(seen) + 1
    rare = [math.log(SMOOTH / (t + SMOOTH * size)) for t in total]
    codes = {ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]): n for g, n in seen.items()}
    ordered = sorted(codes)
    logs = [[math.log((c + SMOOTH) / (t + SMOOTH * size)) for c, t in zip(codes[g], total, strict=True)] for g in ordered]
    own = {s: np.array([c >= SCRIPT_SHARE * t for c, t in zip(n, all_letters, strict=True)]) for s, n in kinds.items()}
    # the last row is for trigrams not in the table; a code that no text has keeps the table from being empty
    return {"names": names, "codes": np.array([*ordered, 1 << 62], np.int64), "logs": np.array([*logs, rare, rare], np.float32).reshape(len(ordered) + 2, len(names)), "own": own}


class Scorer:
    """Scores of words, kept by word, and paths."""

    def __init__(self, model: dict, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.n = len(model["names"])
        self.index: dict[bytes, int] = {}
        self.codes, self.logs = model["codes"], model["logs"]
        self.own = {k: v for k, v in model["own"].items() if v.any() and not v.all()}
        # row 0 is for words without letters; room is doubled as words come
        self.matrix, self.lengths, self.used = np.zeros((1 << 14, self.n), np.float32), np.zeros(1 << 14, np.int64), 1

    def learn(self, words: list[bytes]) -> None:
        """Score words not seen yet, all at once: the codes of their trigrams are found in a sorted table."""
        lows = [letters(w.decode()) for w in words]
        at = np.flatnonzero(np.fromiter(map(len, lows), np.int64, len(lows)))
        for i, w in enumerate(words):
            if not lows[i]:
                self.index[w] = 0
        if not len(at):
            return
        known = [lows[i] for i in at]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        c = np.frombuffer(("^" + "$^".join(known) + "$").encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[(c[:-2] != END) & ((c[1:-1] != END) | (c[2:] != BEGIN))]
        place = np.searchsorted(self.codes, codes)
        place[place == len(self.codes)] = 0
        place[self.codes[place] != codes] = len(self.codes)
        score = np.add.reduceat(self.logs[place], np.cumsum(sizes) - sizes, axis=0)
        for i, low in enumerate(known):
            own = self.own.get("latin" if max(low) < "\u0370" else Counter([script(x) for x in low]).most_common(1)[0][0])
            if own is not None:
                score[i][~own] = -1e9
        score = np.maximum(score - score.max(axis=1, keepdims=True), -WORST)
        while self.used + len(at) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        here = slice(self.used, self.used + len(at))
        self.matrix[here], self.lengths[here] = score, sizes
        for k, i in enumerate(at.tolist(), self.used):
            self.index[words[i]] = k
        self.used += len(at)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        """Start anew when too many words are kept."""
        if len(self.index) > WORDS_KEPT:
            self.__init__(self.model, self.penalty)

    def one_language(self, s: np.ndarray) -> int | None:
        """The language whose one-language path is surely best, or None if the shortcut can't tell."""
        best = int(s.sum(axis=0).argmax())
        gain = np.zeros((len(s) + 1, self.n), np.float32)
        np.cumsum(s - s[:, best : best + 1], axis=0, out=gain[1:])
        low = np.minimum.accumulate(gain, axis=0)
        if (gain - low).max() > self.penalty or gain.max() > self.penalty / 2 or (gain[-1] - gain.min(axis=0)).max() > self.penalty / 2:
            return None
        return best

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word: most points, less the penalty for each switch; ties stay, then go to the first."""
        n, cost = self.n, self.penalty
        value = s[0].tolist()
        back = []
        for row in s[1:].tolist():
            top = max(range(n), key=value.__getitem__)
            switch = value[top] - cost
            back.append([i if value[i] >= switch else top for i in range(n)])
            value = [(v if v >= switch else switch) + x for v, x in zip(value, row, strict=True)]
        now = max(range(n), key=value.__getitem__)
        out = [now]
        for step in reversed(back):
            now = step[now]
            out.append(now)
        return np.array(out[::-1])

    def labels(self, texts: list[bytes | None]) -> list[tuple[str, float, list[tuple[int, int, int]]]]:
        """A label for each text."""
        split = [(t or b"").split() for t in texts]
        if self.n:
            self.learn(list({w for words in split for w in words if w not in self.index}))
        return [self.label(words) if self.n else (UNKNOWN, 0.0, []) for words in split]

    def label(self, words: list[bytes]) -> tuple[str, float, list[tuple[int, int, int]]]:
        """The language with most letters, its share of the letters, and spans (language, first word, end); the words are known."""
        at = self.look_up(words)
        size = self.lengths[at]
        if not size.sum():
            return UNKNOWN, 0.0, []
        s = self.matrix[at]
        one = self.one_language(s)
        if one is not None:
            # how far its mean score per word lies above the next
            totals = np.sort(s.sum(axis=0))
            lead = float(totals[-1] - totals[-2]) if self.n > 1 else 1e9
            return self.model["names"][one], 1 / (1 + math.exp(-min(30.0, lead))), [(one, 0, len(words))]
        path = self.path(s)
        share = np.bincount(path, weights=size, minlength=self.n)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return self.model["names"][int(share.argmax())], float(share.max() / size.sum()), [(int(path[a]), a, z) for a, z in zip(cuts, cuts[1:], strict=False)]


def char_spans(raw: bytes, spans: list[tuple[int, int, int]], names: list[str]) -> list[dict]:
    """Spans of words as code point offsets, from the first letter of the first word to the end of the last."""
    text = raw.decode()
    if len(spans) == 1:
        bare = text.strip(" \t\n\r\x0b\x0c")
        first = text.index(bare)
        return [{"lang": names[spans[0][0]], "start": first, "stop": first + len(bare)}]
    at = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
    return [{"lang": names[k], "start": at[a][0], "stop": at[z - 1][1]} for k, a, z in spans]


_SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def detect(docs: DataFrame, model: dict, text: str = "text", penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and, if asked for, lang_spans (language, code point offsets, end exclusive).

    A text that is null or has no letter is `und` with score 0 and no spans, as is every text if the model knows no language.
    The score of a text of one language is the logistic of its lead over the next; of a mixed text, the share of its letters.
    Very long texts are labelled whole; repeated rows get the same result; an empty table stays empty. A new column
    whose name docs already has gets an underscore before its name.
    """
    fields = [T.StructField(free_name(n, docs.columns), t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_spans", _SPANS))[: 2 + int(spans)]]
    sign = hashlib.sha1(repr((model["names"], model["codes"].tobytes(), model["logs"].tobytes(), penalty)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        scorer: Scorer = per_worker(("language", sign), lambda: Scorer(shared.value, penalty))
        out = scorer.labels(texts)
        arrays = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
        if spans:
            arrays.append(pa.array([char_spans(t, x[2], scorer.model["names"]) if x[2] else [] for t, x in zip(texts, out, strict=True)], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))))
        scorer.forget()
        return arrays

    return append(docs, text, work, fields)


def keep_identified(docs: DataFrame, model: dict, text: str = "text", lang: str | None = None) -> DataFrame:
    """The rows of docs in which a language is found, with the columns of docs; lang, if given, is the column that then bears it.

    Null and empty texts and those without any letter go; repeated rows each stay or go; an empty table stays empty.
    """
    found = detect(docs, model, text, spans=False)
    pred = found.columns[len(docs.columns)]
    return found.where(F.col(pred) != UNKNOWN).select(*[F.col(pred).alias(c) if c == lang else F.col(c) for c in docs.columns])


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    out = detect(docs.select("doc_id", "text"), model, spans=False)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def remainder(doc_id: int, by: int) -> int:
    """crc32 of an id as text, modulo a number."""
    return zlib.crc32(str(doc_id).encode()) % by
