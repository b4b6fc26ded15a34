"""Toxicity (operator 3): a noisy channel restores disguised words, restored words are scored.

A disguised token (leetspeak, separators or spaces between letters, repeated letters) is a lattice: each
character may stand for itself, for the letters it imitates, or for nothing. Viterbi decoding finds the
letters that the channel and a trigram model of letters make likeliest; the model counts the words
of all documents. Restored words and their beginnings are then weighed by how they divide labelled
documents, and a logistic model of a document's weights gives its score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, as_bytes, free_name, over_texts, per_worker, slices

#: Labelled documents of each label, and features, that training takes at most; a feature's least evidence (G squared).
SAMPLE, FEATURES, EVIDENCE = 4000, 20_000, 18.0
#: Lengths of a word's beginnings that are features besides the word.
STARTS = (4, 5, 6, 7)
WORDS_KEPT = 400_000
#: Letters that a character may imitate (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
NOISE = set(".,-_*~^`'\"#%&/\\:;=?)}>]")
#: Log probabilities of the channel.
SAME, IMITATED, DROPPED, NOISE_DROPPED, REPEAT_DROPPED, GAP = math.log(0.9), math.log(0.3), math.log(0.02), math.log(0.6), math.log(0.5), math.log(0.1)
SMOOTH = 0.01
BEGIN, END = "^", "$"
_OUTER = re.compile(r"^[^\w@$!|+(]+|[^\w@$!|+]+$|[!]+$")
_ODD = re.compile(r"(\w)\1\1|[\W\d_]")
_TWICE = re.compile(r"(\w)\1")
_LETTER = re.compile(r"[^\W\d_]")
#: Words of letters from here up are not in the letter model: ideographs and syllables are no letters that others could imitate.
HIGHEST = 0x2E80


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram (three letters with word ends marked), n: over the words of all documents that are letters below HIGHEST only."""

    def table(words: Counter) -> pa.RecordBatch | None:
        known = [(w.lower(), n) for w, n in ((k.decode().strip(".,;:!?\"'()"), n) for k, n in words.items()) if w.isalpha() and max(w) < chr(HIGHEST)]
        if not known:
            return None
        c = np.frombuffer((BEGIN + (END + BEGIN).join([w for w, _ in known]) + END).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin, end = ord(BEGIN), ord(END)
        codes = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[(c[:-2] != end) & ((c[1:-1] != end) | (c[2:] != begin))]
        sizes = np.fromiter((len(w) for w, _ in known), np.int64, len(known))
        grams, at = np.unique(codes, return_inverse=True)
        n = np.bincount(at, np.repeat([n for _, n in known], sizes)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                words.update(b" ".join([t for t in as_bytes(part.column(0)) if t]).split())
                if len(words) > 150_000:
                    if (out := table(words)) is not None:
                        yield out
                    words = Counter()
        if (out := table(words)) is not None:
            yield out

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _spelt(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


class Channel:
    """Restores disguised tokens; counts: trigram code -> count."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.two: Counter = Counter()
        for g, n in counts.items():
            self.two[g >> 21] += n
        self.size = len({g & 0x1FFFFF for g in counts}) + 1

    def log(self, a: str, b: str, c: str) -> float:
        pair = ord(a) << 21 | ord(b)
        return math.log((self.counts.get(pair << 21 | ord(c), 0) + SMOOTH) / (self.two.get(pair, 0) + SMOOTH * self.size))

    def restore(self, token: str, gaps: bool = False) -> list[str]:
        """The likeliest words behind a token, lower-cased; with gaps, the token's characters may belong to several words."""
        # a state's text is a chain of letters back to its beginning, so that states share what they have in common
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {("", BEGIN): (0.0, None)}
        before = ""
        for c in token.lower():
            arcs: list[tuple[str, float]] = []
            if _LETTER.match(c):
                arcs.append((c, SAME))
                if c == before:
                    arcs.append(("", REPEAT_DROPPED))
            else:
                arcs += [(x, IMITATED) for x in LEET.get(c, "")]
                arcs.append(("", NOISE_DROPPED if c in NOISE else REPEAT_DROPPED if c == before else DROPPED))
            now: dict[tuple[str, str], tuple[float, tuple | None]] = {}

            def offer(key: tuple[str, str], score: float, text: tuple | None, now=now) -> None:
                if key not in now or score > now[key][0]:
                    now[key] = (score, text)

            for (a, b), (score, text) in states.items():
                for letter, cost in arcs:
                    if not letter:
                        offer((a, b), score + cost, text)
                        continue
                    offer((b, letter), score + cost + (self.log(a, b, letter) if a else self.start(letter)), (text, letter))
                    if gaps and a:
                        offer((BEGIN, letter), score + cost + GAP + self.log(a, b, END) + self.start(letter), ((text, " "), letter))
            states, before = now, c
        ends = [(score + (self.log(a, b, END) if a else -50.0), text) for (a, b), (score, text) in states.items()]
        best = max(e for e, _ in ends)
        return max(_spelt(text) for e, text in ends if e == best).split()

    def start(self, letter: str) -> float:
        """A word's first letter, from what follows a beginning."""
        if not hasattr(self, "firsts"):
            self.firsts: Counter = Counter()
            for g, n in self.counts.items():
                if g >> 42 == ord(BEGIN):
                    self.firsts[g >> 21 & 0x1FFFFF] += n
            self.all = sum(self.firsts.values())
        return math.log((self.firsts.get(ord(letter), 0) + SMOOTH) / (self.all + SMOOTH * self.size))


class Scorer:
    """Weights of words, kept by token."""

    def __init__(self, counts: dict[int, int], weights: dict[str, float] | None, model: list[float] | None):
        self.channel, self.weights, self.model = Channel(counts), weights or {}, model
        self.kept: dict[bytes, float] = {}

    def words(self, raw: bytes) -> list[str]:
        """The words that a token stands for."""
        token = _OUTER.sub("", raw.decode())
        if token.isalpha() and not _ODD.search(token):
            plain = token.lower()
            return list({plain: None} | dict.fromkeys(self.channel.restore(plain))) if _TWICE.search(plain) else [plain]
        if not token or not (_LETTER.search(token) or any(c in LEET for c in token)):
            return []
        if _LETTER.search(token) is None and not any(not c.isdigit() for c in token):
            return []  # a number is no disguise
        return self.channel.restore(token)

    @staticmethod
    def spaced(tokens: list[bytes]) -> list[str]:
        """Runs of three or more one-character tokens, joined."""
        out, run = [], []
        for t in tokens:
            if len(t) == 1 or (len(t) < 4 and len(t.decode()) == 1):
                run.append(t.decode())
            elif run:
                if len(run) > 2:
                    out.append("".join(run))
                run = []
        return [*out, "".join(run)] if len(run) > 2 else out

    def features(self, text: bytes | None) -> set[str]:
        """The restored words of a text and their beginnings."""
        tokens = (text or b"").split()
        words = {w for t in set(tokens) for w in self.words(t)}
        for s in self.spaced(tokens):
            words.update(self.channel.restore(s, True))
        return words | {"^" + w[:k] for w in words for k in STARTS if len(w) > k}

    def weight(self, words: list[str]) -> float:
        return max((self.weights.get(f, 0.0) for w in words for f in (w, *("^" + w[:k] for k in STARTS if len(w) > k))), default=0.0, key=abs)

    def token(self, raw: bytes) -> float:
        value = self.weight(self.words(raw))
        if len(self.kept) < WORDS_KEPT:
            self.kept[raw] = value
        return value

    def numbers(self, text: bytes | None) -> list[float]:
        """What the logistic model sees: constant, the highest weight, log of the count and of the share of weighty tokens."""
        tokens = (text or b"").split()
        kept = self.kept
        found = [kept[t] if t in kept else self.token(t) for t in tokens]
        found += [self.weight([w]) for s in self.spaced(tokens) for w in self.channel.restore(s, True)]
        high = [x for x in found if x > 0]
        return [1.0, max(high, default=0.0), math.log1p(len(high)), math.log1p(1000 * len(high) / (len(tokens) + 1))]

    def score(self, text: bytes | None) -> float:
        z = sum(a * b for a, b in zip(self.model, self.numbers(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton steps for a small logistic regression; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = ridge * np.array([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (p - y) + shrink * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, letters: DataFrame | None = None) -> dict:
    """A model: letter counts of all docs, weights of features, a logistic model; from at most `sample` documents of each label.

    labels: doc_id and a label of 0 or 1; null labels teach nothing. The sample is the smallest hashes of the ids.
    """
    spark = docs.sparkSession
    counts = {r["gram"]: r["n"] for r in (letters if letters is not None else letter_counts(docs, text)).collect()}  # bounded by the alphabet
    shared = spark.sparkContext.broadcast(counts)
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("key"), F.col(label).cast("int").alias("toxic"))
    order = F.xxhash64(F.col("key").cast("string"))
    taken = known.where("toxic = 1").orderBy(order, "key").limit(sample).union(known.where("toxic = 0").orderBy(order, "key").limit(sample))
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(taken), "key").select("text", "toxic")  # 2 * sample ids at most
    sign = hashlib.sha1(repr(sorted(counts.items())).encode()).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = per_worker(("channel", sign), lambda: Scorer(shared.value, None, None))
        found = (Counter(), Counter())
        seen = [0, 0]

        def table() -> pa.RecordBatch:
            names = [("\0", seen[0], seen[1]), *((f, found[0][f], found[1][f]) for f in found[0].keys() | found[1].keys())]
            return pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.int64()), pa.array([n[2] for n in names], pa.int64())], ["feature", "no", "yes"])

        for batch in batches:
            for part in slices(batch, "text"):
                for raw, toxic in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    found[toxic].update(scorer.features(raw))
                    seen[toxic] += 1
                if len(found[0]) + len(found[1]) > 200_000:
                    yield table()
                    found, seen = (Counter(), Counter()), [0, 0]
        yield table()

    totals = rows.mapInArrow(count, "feature string, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    totals = totals.where("yes >= 3 or feature = '\\0'").orderBy(F.when(F.col("feature") == "\0", 0).otherwise(1), (F.col("yes") / (F.col("no") + 1)).desc(), F.col("yes").desc(), "feature").limit(FEATURES)
    tally = [(r["feature"], r["no"], r["yes"]) for r in totals.collect()]
    no, yes = next(((n, y) for f, n, y in tally if f == "\0"), (0, 0))
    weights = {}
    for f, n, y in tally:
        if f == "\0" or not yes or not no:
            continue
        share, expected = (n + y) / (no + yes), y / yes
        g = 2 * (y * math.log(expected / share) + (n * math.log(n / no / share) if n else 0.0))
        if g >= EVIDENCE and expected > n / no:
            weights[f] = math.log((y + 0.5) / (yes + 1)) - math.log((n + 0.5) / (no + 1))
    # words that a large part of clean documents have too are no evidence by themselves
    weights = {f: w for f, w in weights.items() if w > 2.0}
    out = {"counts": counts, "weights": weights, "model": [0.0, 0.0, 0.0, 0.0]}
    if not no or not yes:
        out["model"][0] = 30.0 if yes else -30.0
        return out
    held = spark.sparkContext.broadcast(weights)
    sign = hashlib.sha1(repr((sign, sorted(weights.items()))).encode()).hexdigest()

    def numbers(part: pa.RecordBatch) -> pa.RecordBatch:
        scorer: Scorer = per_worker(("weights", sign), lambda: Scorer(shared.value, held.value, None))
        values = np.array([scorer.numbers(t) for t in as_bytes(part.column(0))])
        return pa.RecordBatch.from_arrays([*[pa.array(values[:, k]) for k in range(4)], part.column(1)], ["a", "b", "c", "d", "toxic"])

    data = np.array([list(r) for r in over_texts(rows, "text", numbers, "a double, b double, c double, d double, toxic int").collect()])  # 2 * sample rows at most
    out["model"] = logistic(data[:, :4], data[:, 4])
    return out


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5).

    Null and empty texts have the score of a text without any weighty word. Very long texts are scored whole; repeated rows get
    the same score; an empty table stays empty. A new column whose name docs already has gets an underscore before its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # letters of the alphabet and FEATURES words at most
    sign = hashlib.sha1(repr((sorted(model["weights"].items()), model["model"], len(model["counts"]), sum(model["counts"].values()))).encode()).hexdigest()
    fields = [T.StructField(free_name("score", docs.columns), T.DoubleType()), T.StructField(free_name("predicted", docs.columns), T.IntegerType())]

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        m = shared.value
        scorer: Scorer = per_worker(("toxicity", sign), lambda: Scorer(m["counts"], m["weights"], m["model"]))
        found = [scorer.score(t) for t in texts]
        return [pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())]

    return append(docs, text, work, fields)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
