"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
import struct

import pytest

from newsloom.llm import bpe

HARD = [
    None, "", " ", "\n\t\r\x0b\x0c", "Hello  World's 123 foo!!\n<|endoftext|>x", "a<|startoftext|> b <|endoftext|><|endoftext|>", "<|EndOfText|> <| |>", "É naïve—日本 Straße İ ΑΣ ΣΑΣ.", "é ọ̈ 가", " x y　z\x85w\x1cq\x1fq",
    "I'M you'LL don't '’s ''' 's't", "٣٤ ½ ² x² 10²", "👩‍👩‍👧 🇩🇪", "ab" * 3000, "qzxj" * 500, "\x00\x01 ﻿ ​", "ſt ﬁ K Å ǅ", "à́b", "'" * 50, "mixed日本語text", "x" * 20000, "ͅ İ̇",
]


def test_as_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(3)
    rows = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + HARD
    rows += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 1500), r.randrange(0x4E00, 0x4F00), 32])) for _ in range(r.randrange(200))) for _ in range(300)]
    docs = spark.createDataFrame([(i, x, "old") for i, x in enumerate(rows)], "doc_id long, text string, n_tokens string")
    out = {x.doc_id: x for x in bpe.decode(bpe.encode(docs), "ids").collect()}
    assert len(out) == len(rows)
    for i, x in enumerate(rows):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert list(out[i].ids) == ids, x
        assert out[i].n_tokens == "old" and out[i]._n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert out[i].decoded == back


def test_cuts_are_certain():
    e = bpe.encoder(bpe.vocabulary())
    assert e.apart and all(not any(p in t.removesuffix("</w>") for t in e.vocab) for p in list(e.apart)[:200])
    # a word with a cut inside is encoded in more than one fragment
    pair = next(p for p in sorted(e.apart) if p.isalpha() and p.isascii())
    assert e._word("th" + pair + "er") == [x.id for x in e.last.tokenize("th" + pair + "er")]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_decode_odd_ids(spark):
    """Null ids and ids beyond the vocabulary are left out, as the library does; a null array stays null."""
    t = library()
    rows = [([5, None, 7],), ([10**6, 9],), ([],), (None,)]
    got = [r.decoded for r in bpe.decode(spark.createDataFrame(rows, "ids array<int>")).collect()]
    assert got == [t.decode([5, 7], skip_special_tokens=False), t.decode([9], skip_special_tokens=False), "", None]


def test_long_text(spark):
    """A text of over a megabyte, encoded whole."""
    text = " ".join(f"Word{i % 5003} {i}" for i in range(120_000))
    r = bpe.encode(spark.createDataFrame([(text,)], "text string"), ids=False).collect()[0]
    ids = library().encode(text, add_special_tokens=False).ids
    assert len(text) > 1 << 20 and (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string").limit(n)
    assert [(x.n_tokens, x.ids_sha256) for x in bpe.encode(docs).collect()] == [(0, hashlib.sha256(b"").hexdigest())] * n
