"""Personal data (operator 5): regular expressions propose spans, checksums confirm them, context words score them.

Built-in column functions only. Patterns have lookbehinds and possessive quantifiers so that each
position of a text is entered once; they match what the plain patterns of the contract match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import free_name

#: The kinds in the order in which results list them; the first four are the contract's.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    # a run of local-part characters is entered at its start, or where the match before ended within it
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words near a span that raise its score.
CONTEXT = {
    "email": r"e-?mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|credit|visa|payment|debit",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social security|taxpayer|insured",
}
#: Score of a confirmed span without context; context adds NEAR. Spans beyond the contract's kinds need KEEP.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR, KEEP, REACH = 0.3, 0.55, 48


def _confirmed(kind: str, match: Column) -> Column | None:
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0")))
        small = lambda p: (part(p) < 3) | ((part(p) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return S.luhn(match)
    if kind == "phone":
        return S.digit_count(match).between(8, 15)
    if kind == "iban":
        return S.mod97(match)
    return None


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column out: array of struct(kind int, start, stop, text, score), by kind, then start.

    kind indexes KINDS; offsets count code points, stop is exclusive. A null or empty text has an
    empty array. Equal spans of different kinds all stay; repeated rows each get their spans; a very long text or
    one of very many matches takes time in proportion. A column named as out that docs already has is replaced;
    every other column stays, whatever its name. An empty table stays empty.
    """
    taken = [*docs.columns, out]
    names = {k: free_name(f"m_{k}", taken) for k in PATTERNS}
    spans, parts = free_name("found_spans", taken), free_name("found_parts", taken)
    body = F.coalesce(F.col(text), F.lit(""))
    blank = F.array().cast("array<string>")
    has = {"email": F.contains(body, F.lit("@")), "phone": F.contains(body, F.lit("+"))}
    matched = {names[k]: F.regexp_extract_all(body, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    work = docs.withColumns({n: F.when(has[k], matched[n]).otherwise(blank) if k in has else matched[n] for k, n in names.items()})
    found = [S.located(body, F.col(names[k]), PATTERNS[k], i, (lambda m, k=k: _confirmed(k, m)) if _confirmed(k, F.lit("")) is not None else None) for i, k in enumerate(KINDS)]
    work = work.withColumn(spans, F.concat(*found))
    work = work.withColumn(parts, F.when(F.size(spans) > 0, S.chunks(body)).otherwise(blank))

    def scored(s: Column, text_parts: Column) -> Column:
        near = lambda a, z: S.piece(text_parts, a, z)
        around = F.lower(F.concat(near(F.greatest(s["start"] - REACH, F.lit(0)), s["start"]), F.lit(" "), near(s["stop"], s["stop"] + REACH)))
        score = F.lit(0.0)
        for i, k in enumerate(KINDS):
            score = F.when(s["kind"] == i, F.least(F.lit(1.0), F.lit(SCORES[k]) + F.when(around.rlike(CONTEXT[k]), NEAR).otherwise(0.0))).otherwise(score)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text"), score.alias("score"))

    both = F.struct(F.col(spans).alias("spans"), F.col(parts).alias("parts"))
    kept = S.let(both, lambda x: F.filter(F.transform(x["spans"], lambda s: scored(s, x["parts"])), lambda s: (s["kind"] < BASE) | (s["score"] >= KEEP)))
    return work.withColumn(out, kept).drop(spans, parts, *names.values())


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts of the contract's kinds, the hash of its spans, all spans and their scores."""
    out = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("pii", lambda s: s["kind"] < BASE)
    return out.select(
        "doc_id",
        *[S.count(F.col("pii"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])],
        F.sha2(S.listed(base, KINDS), 256).alias("base_sha256"),
        S.listed(F.col("pii"), KINDS).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
