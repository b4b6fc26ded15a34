"""The pipeline's stages against plain Python, one after another."""

import hashlib
import random
import re
import struct
from pathlib import Path

import corpus_pipeline
from newsloom.llm import bpe, contamination, secrets
from tests.llm.test_minhash import brute as groups
from tests.llm.test_spans import brute_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def written(spark, tmp_path, rows, items):
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def made():
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "sta") for b in ("n", "rel", "tis", "voe", "x", "dar")]
    say = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, say(25)) for i in range(3)]
    rows = [(i, say(r.randrange(20, 80)), "en", "s", 1, None) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s", 1, "e") for i in range(8)]  # near copies
    rows += [(200 + i, say(20) + " " + items[i % 3][1].upper() + " " + say(20), "en", "s", 1, None) for i in range(5)]
    rows += [(300, say(30) + ' token="abcd1234efgh5678" ' + say(5), "en", "s", 1, None), (301, say(30) + " " + "0123456789abcdef" * 3, None, None, None, None)]
    rows += [(400, None, "en", "s", 0, None), (401, "", "en", "s", 0, None), (402, "12 !?", None, "s", 5, None), (403, "ba", "en", "s", 2, None)]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = made()
    d = written(spark, tmp_path, rows, items)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "minhash_dedup", "decontaminate", "redact_secrets", "encode"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert {r.lang for r in docs.collect()} == {"en"}  # found, where rows have no label
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}

    kept = [(r[0], r[1]) for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    kept = [(i, t) for i, t in kept if groups(kept, 80)[i][2]]
    marks = [contamination.normal(t) for _, t in items]
    kept = [(i, t) for i, t in kept if not any(m in contamination.normal(t) for m in marks)]
    assert set(out) == {i for i, _ in kept}
    assert {"source", "n_chars", "extra"} <= set(next(iter(out.values())).asDict())
    assert {300, 301, 403} <= set(out) and not {200, 201, 400, 401, 402} & set(out)
    e = bpe.Encoder(bpe.vocabulary())
    for i, t in kept:
        for _, a, z in reversed(brute_secrets(t)):
            t = t[:a] + "[SECRET]" + t[z:]
        ids = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert list(out[i].ids) == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert secrets.KINDS[0] == "assign"


def test_nothing_is_left_behind(spark, tmp_path):
    """The shared folder holds only the last stage's table after a run."""
    d = written(spark, tmp_path, *made())
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("*")) if folder.exists() else set()
    corpus_pipeline.run(spark, d)
    assert [x.name.split("-")[0] for x in set(folder.glob("*")) - before] == ["encode"]


def test_empty(spark, tmp_path):
    d = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, d).count() == 0
