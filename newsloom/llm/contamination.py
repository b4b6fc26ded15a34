"""Benchmark decontamination (operator 2): pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces: in any passage within the budget
one piece must occur unchanged. One automaton finds the pieces of a block of items in a text. Each hit
must first extend to its neighbour piece with few errors, as the halves of a split pattern must, and
then the whole item is compared with the text around the hit by Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, per_worker, slices

#: Edits allowed for each hundred characters of an item, and the shortest piece; the budget shrinks until pieces are as long.
ERRORS, PIECE = 10, 6
#: Normalised items of fewer characters are no reason to drop a document: they stand in ordinary text by chance, and one of them could empty a corpus.
SHORTEST = 20
#: Characters of test items that are sent to the executors at once; a longer benchmark is taken in blocks.
BLOCK_CHARS = 8 << 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(length: int, errors: int = ERRORS) -> int:
    return max(0, min(length * errors // 100, length // PIECE - 1))


def myers(pattern: dict[str, int], m: int, text: str) -> list[int]:
    """The least edit distance of the pattern to any stretch of the text that ends at each place."""
    mask, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    out = []
    get = pattern.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        out.append(score)
    return out


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: int):
        import ahocorasick

        self.items: list[tuple[int, str, int, dict, dict]] = []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        self.pairs: list[list[tuple[int, int, str, dict]]] = []
        for key, text in items:
            if not text:
                continue
            e = budget(len(text), errors)
            cuts = [len(text) * j // (e + 1) for j in range(e + 2)]
            k = len(self.items)
            self.items.append((key, text, e, bits(text), bits(text[::-1])))
            twins = []
            for j, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                pieces.setdefault(text[a:z], []).append((k, a, j))
                # the piece and its sibling, which together hold at most one error more than a pair's share
                first = j & ~1
                low, high = cuts[first], cuts[min(first + 2, e + 1)]
                twins.append((low, high, text[low:high], bits(text[low:high])))
            self.pairs.append(twins)
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if self.items:
            self.automaton.make_automaton()

    def _likely(self, text: str, start: int, k: int, a: int, j: int) -> bool:
        """Whether the pair of pieces around a hit may lie within the budget: halving a pattern halves the errors of one half."""
        low, high, pair, pattern = self.pairs[k][j]
        e, n = self.items[k][2], len(self.pairs[k])
        if n < 2 or high - low == 0:
            return True
        most = 2 * e // n if n % 2 == 0 else 2 * e // (n - 1) + (0 if n > 2 else e)
        at = start - (a - low)
        here = text[max(0, at - most) : at + (high - low) + most]
        if pair in here:
            return True
        return bool(here) and min(myers(pattern, high - low, here)) <= most

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item, distance, start, stop of the best passage for each item in a normalised text; ties go to the first."""
        if not self.items:
            return []
        spots: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            start = end + 1 - size
            for k, a, j in places:
                known = spots.setdefault(k, [])
                at = start - a
                # hits of one passage lie on nearby diagonals and are verified together
                if known and abs(known[-1] - at) <= self.items[k][2]:
                    continue
                if self._likely(text, start, k, a, j):
                    known.append(at)
        out = []
        for k, starts in spots.items():
            key, item, e, pattern, back = self.items[k]
            best = None
            for at in starts:
                low, high = max(0, at - 2 * e), min(len(text), at + len(item) + 2 * e)
                whole = text.find(item, low, high)
                if whole >= 0:
                    found = (0, whole, whole + len(item))
                else:
                    scores = myers(pattern, len(item), text[low:high])
                    least = min(scores, default=e + 1)
                    if least > e:
                        continue
                    stop = low + scores.index(least) + 1
                    first = max(low, stop - len(item) - e)
                    turned = myers(back, len(item), text[first:stop][::-1])
                    found = (least, stop - 1 - turned.index(min(turned)), stop)
                if best is None or found < best:
                    best = found
            if best is not None:
                out.append((key, *best))
        return sorted(out)


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int, shortest: int = 1) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition at a time; equal texts stay apart by their ids."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).toLocalIterator():
        item = normal(row["t"])
        if len(item) >= shortest and row["i"] is not None:
            block.append((row["i"], item))
            size += len(item)
        if size >= most:
            yield sorted(block)
            block, size = [], 0
    yield sorted(block)


def _matcher(shared, tag: str, errors: int) -> Matcher:
    return per_worker(("benchmark", tag, errors), lambda: Matcher(shared.value, errors))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", errors: int = ERRORS, block_chars: int = BLOCK_CHARS, shortest: int = 1) -> DataFrame:
    """doc_id, item_id, distance, start, stop: the best passage of each document for each item within its budget.

    Texts are compared in lower case with runs of white space as one space; start and stop are code points of the text so
    normalised. The budget is `errors` edits for each hundred characters of the item, less for items so short that pieces would fall below
    PIECE characters. Null and empty texts, and items of fewer than `shortest` characters, match nothing; very long texts are searched whole; repeated rows
    each give their matches; an empty table on either side gives no rows. A benchmark of any size is taken in blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("item_id", "distance", "start", "stop")]])
    out = None
    for block in blocks(benchmark, item_id, item_text, block_chars, shortest):
        shared = spark.sparkContext.broadcast(block)  # bounded by block_chars
        tag = str(hash(tuple(block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, tag=tag) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, tag, errors)
            for batch in batches:
                for part in slices(batch, "text"):
                    at, found = [], []
                    for i, raw in enumerate(as_bytes(part.column(1))):
                        for m in matcher.find(normal(raw.decode()) if raw else ""):
                            at.append(i)
                            found.append(m)
                    if at:
                        values = np.array(found, np.int64)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *[pa.array(values[:, k]) for k in range(4)]], ["doc_id", "item_id", "distance", "start", "stop"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", errors: int = ERRORS, block_chars: int = BLOCK_CHARS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs without any passage of the benchmark, with the columns of docs.

    Rows with a null or empty text stay, as do all rows where no item has `shortest` characters; repeated rows each stay or go; an empty table stays empty.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)
    for block in blocks(benchmark, item_id, item_text, block_chars, shortest):
        shared = spark.sparkContext.broadcast(block)  # bounded by block_chars
        tag = str(hash(tuple(block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, tag=tag) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, tag, errors)
            for batch in batches:
                for part in slices(batch, text):
                    keep = [not matcher.find(normal(raw.decode()) if raw else "") for raw in as_bytes(part.column(at))]
                    yield part if all(keep) else part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
