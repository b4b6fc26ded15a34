"""Secret scans (operator 8): fixed patterns, and character Markov models of random strings and ordinary identifiers.

Built-in column functions only, for training as for the scan. The models are bigram counts of
labelled samples; a candidate's score is the mean log-likelihood ratio of its bigrams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import free_name

#: The kinds in the order in which ties are listed; the first three are the contract's.
KINDS = ["assign", "access", "hex", "random"]
BASE = 3
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    # long runs with both a letter and a digit
    "random": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+",
}
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Characters of the models; anything else counts as the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIZE = len(ALPHABET) + 1
#: Mean log-likelihood ratio of a bigram from which a candidate counts as random, and the additive smoothing.
THRESHOLD, SMOOTH = 0.6, 0.2
#: Samples of each label at most; a bound on what training reads.
SAMPLES = 20_000
#: Parts of which the built-in sample of ordinary identifiers is made.
PARTS = "get set user name file path data list map key value index count total order item node tree page link table column row query result error message event handler config option client server request response session cache buffer stream reader writer parser builder factory manager service model view controller test main init load save open close read write update delete create insert remove find search sort filter group merge split join start stop next last first size length width height color image text string number date time year month week report version release http https html json xml utf api web app max min sum avg temp local global public static final return class import".split()


def builtin_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """token, random: encodings of hashes, and joined words in the usual styles with some digits."""
    i = F.col("id")
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 256))
    b64 = F.base64(digest("a"))
    noise = F.when(i % 4 == 0, F.substring(b64, 1, 40)).when(i % 4 == 1, F.regexp_replace(b64, "[+/=]", "")).when(i % 4 == 2, F.lower(F.hex(digest("b")))).otherwise(F.translate(F.substring(b64, 1, 32), "+/", "_-"))
    words = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda salt: F.get(words, F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(PARTS))).cast("int"))
    four = [pick(s) for s in ("p", "q", "r", "s")]
    tail = F.when(i % 3 == 0, F.pmod(F.xxhash64(F.lit("n"), i), F.lit(2100)).cast("string")).otherwise("")
    plain = F.when(i % 4 == 0, F.concat_ws("_", *four, tail)).when(i % 4 == 1, F.concat(four[0], *[F.initcap(x) for x in four[1:]], tail)).when(i % 4 == 2, F.concat_ws("-", *four, tail)).otherwise(F.concat(F.lit("/"), F.concat_ws("/", *four), tail))
    ids = spark.range(n)
    return ids.select(noise.alias("token"), F.lit(True).alias("random")).union(ids.select(plain.alias("token"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log ratios P(next | char, random) / P(next | char, ordinary), row by row; samples: token, random."""
    marked = samples.where("token is not null and random is not null")
    order = [F.xxhash64("token"), "token"]  # so that the choice is the same however rows lie
    marked = marked.where("random").orderBy(*order).limit(SAMPLES).union(marked.where("not random").orderBy(*order).limit(SAMPLES))
    codes = marked.select("random", codes_of(F.col("token")).alias("c"))
    pairs = codes.select("random", F.explode(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: a * SIZE + b)).alias("pair"))
    counts = {True: [SMOOTH] * SIZE * SIZE, False: [SMOOTH] * SIZE * SIZE}
    for row in pairs.groupBy("random", "pair").count().collect():  # two tables of SIZE * SIZE numbers at most
        counts[row["random"]][row["pair"]] += row["count"]
    out = []
    for a in range(SIZE):
        total = {k: sum(v[a * SIZE : (a + 1) * SIZE]) for k, v in counts.items()}
        out += [math.log(counts[True][p] / total[True]) - math.log(counts[False][p] / total[False]) for p in range(a * SIZE, (a + 1) * SIZE)]
    return out


def codes_of(token: Column) -> Column:
    """The characters of a token as indexes of ALPHABET."""
    place = lambda c: F.call_function("locate", c, F.lit(ALPHABET))
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.when(place(c) > 0, place(c) - 1).otherwise(SIZE - 1))


def ratio(token: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's bigrams under the table that train() gave; 0 for a shorter token."""
    logs = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(a: Column, c: Column) -> Column:
        more = F.when(a["before"] >= 0, F.get(logs, a["before"] * SIZE + c)).otherwise(0.0)
        return F.struct(c.alias("before"), (a["sum"] + more).alias("sum"), (a["n"] + 1).alias("n"))

    return F.aggregate(codes_of(token), start, step, lambda a: F.when(a["n"] > 1, a["sum"] / (a["n"] - 1)).otherwise(0.0))


_TABLE: list[float] = []


def default_table(spark: SparkSession) -> list[float]:
    """The table for the built-in samples, which is the same for any input."""
    if not _TABLE:
        _TABLE.extend(train(builtin_samples(spark)))
    return _TABLE


def find(docs: DataFrame, text: str = "text", table: list[float] | None = None, out: str = "secrets") -> DataFrame:
    """docs with a column out: array of struct(kind int, start, stop, text), by start, then kind.

    kind indexes KINDS; offsets count code points, stop is exclusive. `random` spans are long runs
    that touch no span of the fixed kinds and whose mean log ratio passes THRESHOLD. A null or empty
    text has an empty array; repeated rows each get their spans; a very long text or one of very many matches takes
    time in proportion. A column named as out that docs already has is replaced; every other column stays,
    whatever its name. An empty table stays empty.
    """
    table = table or default_table(docs.sparkSession)
    taken = [*docs.columns, out]
    names = {k: free_name(f"m_{k}", taken) for k in PATTERNS}
    base, more = free_name("base_spans", taken), free_name("more_spans", taken)
    body = F.coalesce(F.col(text), F.lit(""))
    work = docs.withColumns({names[k]: F.regexp_extract_all(body, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    keep = {"assign": lambda m: F.length(F.regexp_extract(m, _VALUE, 1)) >= 8, "random": lambda m: ratio(m, table) >= THRESHOLD}
    found = {k: S.located(body, F.col(names[k]), PATTERNS[k], i, keep.get(k)) for i, k in enumerate(KINDS)}
    work = work.withColumn(base, F.concat(*[found[k] for k in KINDS[:BASE]])).withColumn(more, found["random"])
    by_place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["text"].alias("text"))
    ordered = F.array_sort(F.transform(F.concat(base, S.apart(F.col(more), F.col(base))), by_place))
    return work.withColumn(out, ordered).drop(base, more, *names.values())


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", table: list[float] | None = None) -> DataFrame:
    """docs with each stretch of text that secrets cover replaced by the mark; other columns and texts stay as they are.

    Spans that overlap give one mark. Null and empty texts stay; so does an empty table.
    """
    spans, parts = free_name("secret_spans", docs.columns), free_name("secret_parts", docs.columns)
    found = find(docs, text, table, spans).withColumn(parts, F.when(F.size(spans) > 0, S.chunks(F.col(text))))
    # how far spans reach up to each, which is where the text after it goes on
    reach = S.running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))

    def joined(x: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(0)
            return F.when(s["start"] >= before, F.concat(S.piece(x["parts"], before, s["start"]), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform(x["spans"], part), ""), S.piece(x["parts"], F.element_at(x["reach"], -1), F.length(text)))

    cleared = S.let(F.struct(F.col(spans).alias("spans"), F.col(parts).alias("parts"), reach.alias("reach")), joined)
    return found.withColumn(text, F.when(F.size(spans) > 0, cleared).otherwise(F.col(text))).drop(spans, parts)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts by kind, the hash of the contract's spans, and all spans."""
    out = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("secrets", lambda s: s["kind"] < BASE)
    return out.select(
        "doc_id",
        *[S.count(F.col("secrets"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(S.listed(base, KINDS), 256).alias("base_sha256"),
        S.listed(F.col("secrets"), KINDS).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
