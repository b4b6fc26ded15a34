"""Token files: exact round trips, ids against the tokenizers library."""

import random
import struct
import zlib

import numpy as np
import pytest

from newsloom.llm import tokenfile
from newsloom.llm.bpe import vocabulary

HARD = [None, "", " ", "  ", "a  b", "a   b", "\n b", "x\n \ny", "x\n  b", " lead", "trail ", "a\tb \n c", "é日本 x　 y", "Hello<|endoftext|> bar <|endoftext|>", "<|endoftext|>", "I'm you'll 's", "a" * 5000, "x " * 3000, "   z", "💥 💥", "a   b", "end.\n\nNext  line"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(tokenfile.NAME))


def made(spark, sf):
    r = random.Random(9)
    rows = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + HARD
    rows += ["".join(r.choices(" \n\tab,.é日1", k=r.randrange(60))) for _ in range(300)]
    ids = r.sample(range(-1000, 10**9), len(rows))
    return list(zip(ids, rows, strict=True))


def test_as_library(spark, sf):
    rows, t = made(spark, sf), library()
    docs = spark.createDataFrame([(i, x, "s") for i, x in rows], "doc_id long, text string, shard string").repartition(3)
    segments = tokenfile.write(docs)
    got = {r.doc_id: r for r in tokenfile.digest(segments).collect()}
    back = {r.doc_id: r for r in tokenfile.read(segments).collect()}
    assert len(got) == len(rows)
    start = 0
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert back[i].ids == ids and back[i].start == start, x
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


@pytest.mark.parametrize("bit", [False, True])
def test_round_trip(bit):
    r = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 100, 1000):
        ids = r.integers(0, 1 << r.integers(1, 33), n, dtype=np.uint64).astype("<u4")
        counts = [n // 3, 0, n - n // 3]
        s = tokenfile.Segment(tokenfile.write_segment([5, -6, 1 << 60], counts, ids, chunk=64, bit=bit))
        assert (s.ids() == ids).all() and s.doc_ids.tolist() == [5, -6, 1 << 60] and s.counts.tolist() == counts
        for k in range(len(s.index)):
            assert (s.read_chunk(k) == ids[64 * k : 64 * (k + 1)]).all()
    with pytest.raises(ValueError):
        tokenfile.Segment(b"x" * 64)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "gone"), (3, "a b"), (3, "a b"), (1, None)], "doc_id long, text string")
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in tokenfile.digest(tokenfile.write(docs)).collect()))
    assert [(i, n) for _, i, n in got] == [(None, 2), (1, 1), (3, 3), (3, 3)] and [s for s, _, _ in got] == [0, 2, 3, 6]
    assert tokenfile.digest(tokenfile.write(docs.limit(0))).count() == 0


def test_segments_and_long_text(spark, monkeypatch):
    """Several segments to a shard, and one text of over a megabyte: starts run on, ids are the library's."""
    monkeypatch.setattr(tokenfile, "SEGMENT", 50)
    long = " ".join(f"word{i % 977} x{i}" for i in range(90_000))
    rows = [(i, f"some words {i} " * (i % 7)) for i in range(200)] + [(77_000, long)]
    t, start = library(), 0
    segments = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"))
    assert segments.groupBy("shard").count().where("count > 3").count()
    got = {r.doc_id: r for r in tokenfile.digest(segments).collect()}
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
