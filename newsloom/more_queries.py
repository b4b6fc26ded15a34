"""More registered queries: plans, reviews, catalogues, pages and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import dedup as D
from .operators import evaluation as E
from .operators import feed as O
from .operators import stats as M
from .operators import sync as S
from .operators import temporal as P
from .plans import reports as L
from .queries import ORACLES, T_, TS_SQL, at, query
from .sources import tables as R


@query("D24_story_detail")
def story_detail(spark, sf):
    return L.story_detail(R.items(spark, sf), R.stories(spark, sf)).select("story_id", "items", "official", "publishers", at("first_at").alias("first_at"), at("last_at").alias("last_at"))


ORACLES["D24_story_detail"] = f"""WITH RECURSIVE {R.oracle_items()}, {R.oracle_stories()},
  walk AS (SELECT story_id AS id, story_id AS here, 0 AS depth FROM stories UNION ALL SELECT w.id, s.redirect_to, depth + 1 FROM walk w JOIN stories s ON s.story_id = w.here WHERE s.redirect_to IS NOT NULL AND depth < 70),
  ends AS (SELECT id, arg_max(here, depth) AS here, max(depth) AS depth FROM walk GROUP BY id)
  SELECT e.here AS story_id, count(*) AS items, count(*) FILTER (official) AS official, count(DISTINCT publisher) AS publishers, strftime(min(published_at), {TS_SQL}) AS first_at, strftime(max(published_at), {TS_SQL}) AS last_at
  FROM items i JOIN ends e ON e.id = i.story_id WHERE coalesce(tmt, 1) <> 0 AND depth < 70 AND e.here IN (SELECT story_id FROM stories) GROUP BY e.here"""


@query("X31_structured_report", "SELECT item_id, channel, citation::INT AS citation FROM (SELECT *, row_number() OVER (ORDER BY channel, r) AS citation FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY coalesce(score, 50) DESC, item_id DESC) AS r FROM items WHERE coalesce(tmt, 1) <> 0) WHERE r <= 15)", True)
def structured_report(spark, sf):
    return L.structured_report(R.items(spark, sf), 15).select("item_id", "channel", "citation")


@query("A33_self_check", """, t AS (SELECT sum(n) AS n, max(n) AS top, sum(o) AS o FROM (SELECT source_id, count(*) AS n, count(*) FILTER (score IS NULL) AS o FROM items GROUP BY source_id))
  SELECT 'source_share' AS "check", round(top / n, 6) AS value, top / n <= 0.5 AS ok FROM t UNION ALL SELECT 'unscored', round(o / n, 6), o / n <= 0.3 FROM t UNION ALL SELECT 'any', n::DOUBLE, n > 0 FROM t""", True)
def self_check(spark, sf):
    return L.self_check(R.items(spark, sf)).withColumn("value", F.round("value", 6))


@query("D4_news_signals", """SELECT item_id, CASE WHEN score >= 0 THEN score END AS score, independence FROM (SELECT *, CASE WHEN official THEN 'official' WHEN story_id IS NULL OR item_id = min(item_id) OVER (PARTITION BY story_id) THEN 'report' ELSE 'repost' END AS independence
  FROM items WHERE coalesce(tmt, 1) <> 0 AND published_at > TIMESTAMP '2024-01-05' AND published_at <= TIMESTAMP '2024-01-12') ORDER BY published_at DESC, item_id DESC LIMIT 100""", True)
def news_signals(spark, sf):
    return L.news_signals(R.items(spark, sf), "2024-01-05", "2024-01-12", 100).select("item_id", "score", "independence")


@query("D25_source_status", """, r AS (SELECT user_id AS source_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS good, max(ts) FILTER (event_type <> 'error') AS last_ok, arg_max(event_type <> 'error', ts) AS last FROM events GROUP BY user_id),
  a AS (SELECT *, (epoch(TIMESTAMP '2024-02-01') - epoch(last_ok)) / 3600.0 AS age FROM r)
  SELECT source_id, runs, good, CASE WHEN good = 0 THEN 'never' WHEN NOT last AND age > 72 THEN 'bad' WHEN age > 72 THEN 'stale' WHEN good < runs THEN 'partial' ELSE 'ok' END AS status FROM a""", True)
def source_status(spark, sf):
    log = T_(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("ran_at"), (F.col("event_type") != "error").alias("ok"))
    return L.source_status(log, "2024-02-01", 72)


@query("D26_effective_status", "SELECT doc_id, coalesce(decision, 'candidate') AS effective FROM documents LEFT JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'accepted' ELSE 'rejected' END AS decision FROM labels) USING (doc_id)")
def effective(spark, sf):
    a = T_(spark, sf, "documents").select("doc_id", F.lit("candidate").alias("status"))
    r = T_(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), F.col("doc_id").alias("sequence"))
    return E.effective(a, r, "doc_id").select("doc_id", "effective")


@query("A22_reviewer_pairs", """, r AS (SELECT event_id // 3 AS c, event_id % 3 AS who, event_type AS d FROM events) SELECT a.who AS a, b.who AS b, count(*) AS n, count(*) FILTER (a.d = b.d) AS same FROM r a JOIN r b ON a.c = b.c AND a.who < b.who GROUP BY ALL""", True)
def reviewer_pairs(spark, sf):
    r = T_(spark, sf, "events").select(F.expr("event_id div 3").alias("c"), (F.col("event_id") % 3).alias("who"), F.col("event_type").alias("d"))
    return E.reviewer_pairs(r, "c", "who", "d")


#: A quote for each document: some words of it, or of what comes one place later, with offsets that vary and a hash that is wrong for some.
_QUOTE = """, q AS (SELECT doc_id, text, doc_id % 97 AS a, doc_id % 97 + 5 + doc_id % 40 AS z, doc_id % 3 AS kind FROM documents)
  SELECT doc_id, coalesce(z <= len(text) AND (kind <> 1 OR substring(text, a + 1, z - a) = substring(text, a + 2, z - a)) AND kind <> 2, false) AS ok FROM q"""


@query("D19_quotes", _QUOTE, True)
def quotes(spark, sf):
    t, i = F.col("text"), F.col("doc_id")
    start = (i % 97).cast("int")
    stop = (i % 97 + 5 + i % 40).cast("int")
    # the quote of every third document is cut a place too late, the hash of every third is another's
    quote = F.when(F.length(t) >= stop, F.substring(t, start + F.when(i % 3 == 1, 2).otherwise(1), stop - start))
    sha = F.when(i % 3 == 2, F.sha2(F.lit("another"), 256)).otherwise(F.sha2(quote, 256))
    return T_(spark, sf, "documents").select("doc_id", E.quoted(t, quote, start, stop, sha).alias("ok"))


@query("D13_first_failure", "SELECT o_orderkey, CASE WHEN NOT o_totalprice > 1000 THEN 'price' WHEN NOT o_orderstatus <> 'P' THEN 'status' WHEN NOT o_custkey % 2 = 0 THEN 'customer' END AS failure FROM orders")
def first_failure(spark, sf):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P", "customer": F.col("o_custkey") % 2 == 0}
    return T_(spark, sf, "orders").select("o_orderkey", E.first_failure(rules).alias("failure"))


@query("D16_amendments", """, f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS company, l_returnflag AS form, l_partkey % 50 AS period, l_linenumber = 3 AS amendment FROM lineitem)
  SELECT a.id AS filing_id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, CASE WHEN n = 1 THEN t END AS target
  FROM f a LEFT JOIN (SELECT company, form, period, count(*) AS n, min(id) AS t FROM f WHERE NOT amendment GROUP BY ALL) o ON a.company = o.company AND a.form = o.form AND a.period = o.period WHERE a.amendment""", True)
def amendments(spark, sf):
    f = T_(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("filing_id"), F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("form"), (F.col("l_partkey") % 50).alias("period"), (F.col("l_linenumber") == 3).alias("amendment"))
    return E.amendments(f)


@query("T8_tier_plan", """, c AS (SELECT c_nationkey * 1000 + c_custkey % 30 AS company, arg_max(c_name, (c_acctbal, c_name)) AS ticker, max(c_acctbal) AS cap, max(c_mktsegment) AS industry FROM customer GROUP BY 1),
  r AS (SELECT company, 'top' AS reason FROM (SELECT company FROM c ORDER BY cap DESC, company LIMIT 20) UNION SELECT company, 'tier' FROM c WHERE cap >= 9000 AND industry IS NOT NULL UNION SELECT company, 'request' FROM c WHERE company IN (SELECT n_nationkey * 1000 FROM nation))
  SELECT c.company, string_agg(reason, ',' ORDER BY reason) AS reasons, ticker FROM r JOIN c ON c.company = r.company GROUP BY ALL""", True)
def tier_plan(spark, sf):
    c = T_(spark, sf, "customer").select((F.col("c_nationkey") * 1000 + F.col("c_custkey") % 30).alias("company"), F.col("c_name").alias("ticker"), F.col("c_acctbal").alias("cap"), F.col("c_mktsegment").alias("industry"))
    return E.tier_plan(c, 20, 9000, T_(spark, sf, "nation").select((F.col("n_nationkey") * 1000).cast("bigint").alias("company"))).select("company", "reasons", "ticker")


@query("X1_outlook")
def outlook(spark, sf):
    days = T_(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    sizes = days.select("day", (F.unix_date("day") * 10 + F.col("n") % 5).cast("bigint").alias("used"), (F.lit(1_000_000) - F.unix_date("day") * 10).cast("bigint").alias("free"))
    return E.outlook(sizes, "day", "used", "free", 1000)


@query("D12_split_faults", "SELECT 'unassigned' AS fault, event_id AS id FROM events WHERE event_type = 'error' AND NOT value > 50 UNION ALL SELECT 'unused', user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)")
def split_faults(spark, sf):
    e = T_(spark, sf, "events")
    name = lambda df: df.select(F.col("event_id").alias("evidence_id"), F.col("user_id").alias("event_id"))
    return E.split_faults(name(e.where("event_type = 'error'")), name(e.where("event_type = 'error' and value > 50")), e.select(F.col("user_id").alias("event_id")).distinct())


@query("A30_fingerprint", "SELECT count(*) AS n, sum(('0x' || substr(sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_custkey::VARCHAR) || ':' || o_custkey || length(o_orderstatus) || ':' || o_orderstatus), 1, 15))::UBIGINT::HUGEINT)::VARCHAR AS digest FROM orders")
def fingerprint(spark, sf):
    return M.fingerprint(T_(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("A17_distribution", "SELECT lang, source, count(*) AS n, GROUPING(lang)::INT AS all_langs, GROUPING(source)::INT AS all_sources FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def distribution(spark, sf):
    return M.distribution(T_(spark, sf, "documents"), ["lang", "source"])


@query("U1_union", "SELECT user_id AS id FROM events WHERE event_type = 'error' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union(spark, sf):
    return T_(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("id")).union(T_(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("U12_set_operations", "SELECT * FROM (SELECT user_id AS id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') EXCEPT SELECT user_id FROM events WHERE event_type = 'signup'")
def set_operations(spark, sf):
    of = lambda t: T_(spark, sf, "events").where(F.col("event_type") == t).select(F.col("user_id").alias("id"))
    return of("click").intersect(of("purchase")).subtract(of("signup"))


@query("U5_observe_on_change", "SELECT event_id FROM (SELECT event_id, sha256(event_type || (event_id % 2)) AS h, lag(sha256(event_type || (event_id % 2))) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE h IS DISTINCT FROM p")
def observe_on_change(spark, sf):
    e = T_(spark, sf, "events").withColumn("h", F.sha2(F.concat("event_type", (F.col("event_id") % 2).cast("string")), 256))
    return P.changes_only(e, "user_id", ["event_id"], "h").select("event_id")


@query("SC6_columnar_arrays", "SELECT event_type, item, i FROM (SELECT event_type, unnest(list(event_id ORDER BY event_id)) AS item, generate_subscripts(list(event_id ORDER BY event_id), 1)::INT AS i FROM events GROUP BY event_type) WHERE i <= 40")
def columnar_arrays(spark, sf):
    packed = T_(spark, sf, "events").transform(lambda e: O.top_per_group(e, "event_type", [F.col("event_id")], 40)).groupBy("event_type").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return packed.select("event_type", F.posexplode("ids").alias("p", "item")).select("event_type", "item", (F.col("p") + 1).alias("i"))


@query("F24_publisher_host", r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?:#]+)', 1)) AS host FROM pages")
def host(spark, sf):
    return T_(spark, sf, "pages").select("page_id", X.host(F.col("url")).alias("host"))


@query("J5_labels_missing", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def labels_missing(spark, sf):
    return S.missing_references(T_(spark, sf, "labels").select("doc_id"), "doc_id", T_(spark, sf, "documents"), "doc_id")
