"""Queries of the library's own operators by name, and the SQL that gives the same rows.

Names begin with the operator's number in the survey. Timestamps leave queries as text so that no
session time zone matters; doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import dedup as D
from .operators import feed as O
from .operators import stats as M
from .operators import sync as S
from .operators import temporal as P
from .sources import tables as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Format of timestamps in results, for Spark and for the oracles.
TS, TS_SQL = "yyyy-MM-dd HH:mm:ss", "'%Y-%m-%d %H:%M:%S'"


def query(name: str, oracle: str | None = None, views: bool = False):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = R.with_views(oracle) if views else oracle
        return f

    return add


def at(column: str) -> F.Column:
    return F.date_format(column, TS)


def mark(events: DataFrame, tenths: int) -> int:
    """A high water that grows with the table: some tenths of its greatest event_id."""
    return (events.agg(F.max("event_id")).first()[0] or 0) * tenths // 10


def T_(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return R.table(spark, sf, name)


# Filters, feeds, ranking


@query("P1_visible", "SELECT channel, count(*) AS n FROM items WHERE coalesce(tmt, 1) <> 0 GROUP BY channel", True)
def visible(spark, sf):
    return O.visible(R.items(spark, sf)).groupBy("channel").agg(F.count("*").alias("n"))


@query("P2_selected_feed", """SELECT item_id, story_id FROM items i WHERE coalesce(score >= 70, false) OR (official AND NOT routine)
  OR (coalesce(score, 30) >= 30 AND story_id IN (SELECT story_id FROM stories WHERE source_count >= 2 AND redirect_to IS NULL))""", True)
def selected(spark, sf):
    return O.selected(R.items(spark, sf), R.stories(spark, sf)).select("item_id", "story_id")


@query("P4_feed_filters", "SELECT item_id FROM items WHERE channel = 'ai' AND event_type IN ('click', 'purchase') AND story_id IN (SELECT story_id FROM items WHERE company = 'c3')", True)
def feed_filters(spark, sf):
    items = R.items(spark, sf)
    wanted = items.where("company = 'c3'").select("story_id")
    return items.where("channel = 'ai' and event_type in ('click', 'purchase')").join(wanted, "story_id", "left_semi").select("item_id")


@query("P6_whole_word", r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') AS any_case, regexp_matches(text, '(^|[^A-Za-z0-9])The([^A-Za-z0-9]|$)') AS exact, contains(lower(text), 'é') AS part FROM documents")
def whole_word(spark, sf):
    t = F.col("text")
    return T_(spark, sf, "documents").select("doc_id", X.word_match(t, "the").alias("any_case"), X.word_match(t, "=The").alias("exact"), X.word_match(t, "é").alias("part"))


@query("P10_point_in_time", "SELECT item_id, CASE WHEN minute(published_at) < 30 AND score <> -1 THEN score END AS score, CASE WHEN minute(published_at) < 30 THEN mood END AS mood FROM items", True)
def point_in_time(spark, sf):
    known = F.minute("published_at") < 30
    return R.items(spark, sf).select("item_id", F.when(known & (F.col("score") != -1), F.col("score")).alias("score"), F.when(known, F.col("mood")).alias("mood"))


@query("P11_keep_rule", "SELECT item_id FROM items WHERE official OR coalesce(tmt = 1, false) OR (company IN ('c1', 'c2') AND coalesce(score >= 31, false))", True)
def keep_rule(spark, sf):
    keep = F.col("official") | F.coalesce(F.col("tmt") == 1, F.lit(False)) | (F.col("company").isin("c1", "c2") & F.coalesce(F.col("score") >= 31, F.lit(False)))
    return R.items(spark, sf).where(keep).select("item_id")


@query("P12_null_safe", "SELECT count(*) AS n FROM items a WHERE tmt IS NOT DISTINCT FROM (CASE WHEN item_id % 2 = 0 THEN 1 END)", True)
def null_safe(spark, sf):
    return R.items(spark, sf).where(F.col("tmt").eqNullSafe(F.when(F.col("item_id") % 2 == 0, 1))).agg(F.count("*").alias("n"))


_FIRST = """SELECT item_id, strftime(published_at, {ts}) AS published_at FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(story_id, concat('item:', item_id))
  ORDER BY published_at DESC, official DESC, coalesce(score, -1) DESC, item_id DESC) AS r FROM items WHERE coalesce(tmt, 1) <> 0) WHERE r = 1""".replace("{ts}", TS_SQL)


@query("W1_first_per_story", _FIRST, True)
def first_per_story(spark, sf):
    return O.first_per_story(O.visible(R.items(spark, sf))).select("item_id", at("published_at").alias("published_at"))


@query("W2_floor_then_fill", """, ranked AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY coalesce(score, 50) DESC, value DESC, item_id DESC) AS rank FROM items),
  filled AS (SELECT *, 1 AS reserved FROM ranked WHERE rank <= 20 UNION ALL SELECT *, 0 FROM (SELECT * FROM ranked WHERE rank > 20 ORDER BY coalesce(score, 50) DESC, value DESC, item_id DESC LIMIT 120))
  SELECT item_id, channel, rank::INT AS rank FROM filled ORDER BY reserved DESC, coalesce(score, 50) DESC, value DESC, item_id DESC LIMIT 120""", True)
def floor_fill(spark, sf):
    order = [F.coalesce("score", F.lit(50)).desc(), F.col("value").desc(), F.col("item_id").desc()]
    return O.floor_then_fill(R.items(spark, sf), "channel", order, 20, 120).select("item_id", "channel", "rank")


@query("T1_page_lookahead", "SELECT item_id FROM items ORDER BY published_at DESC, item_id DESC LIMIT 51 OFFSET 100", True)
def page(spark, sf):
    return O.page(R.items(spark, sf), [F.col("published_at").desc(), F.col("item_id").desc()], 50, 100).select("item_id")


@query("T2_keyset", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 100 OR (o_custkey = 100 AND o_orderkey > 500) ORDER BY o_custkey DESC, o_orderkey LIMIT 40")
def keyset(spark, sf):
    return O.after_key(T_(spark, sf, "orders"), [("o_custkey", True, 100), ("o_orderkey", False, 500)], 40).select("o_orderkey", "o_custkey")


@query("T3_hot_list", "SELECT story_id, source_count, heat FROM stories ORDER BY source_count >= 2 DESC, heat DESC, story_id LIMIT 30", True)
def hot(spark, sf):
    return O.hot(R.stories(spark, sf), 30).select("story_id", "source_count", "heat")


@query("T4_top_per_group", "SELECT item_id, company FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY value DESC, item_id) AS r FROM items) WHERE r <= 5", True)
def top_per_group(spark, sf):
    return O.top_per_group(R.items(spark, sf), "company", [F.col("value").desc(), F.col("item_id")], 5).select("item_id", "company")


@query("T6_interleave", "SELECT item_id FROM (SELECT item_id FROM items ORDER BY item_id LIMIT 25) UNION SELECT item_id FROM (SELECT item_id FROM items ORDER BY item_id DESC LIMIT 75)", True)
def interleave(spark, sf):
    return O.interleave(R.items(spark, sf), "item_id", 25, 75).select("item_id")


@query("T7_capped_count", "SELECT least(count(*), 500) AS n FROM orders WHERE o_orderstatus = 'O'")
def capped(spark, sf):
    return O.capped_count(T_(spark, sf, "orders").where("o_orderstatus = 'O'"), 500)


@query("A5_story_stats", """SELECT story_id, round(max(value) * (1 + 0.2 * least(greatest(count(DISTINCT publisher) - 1, 0), 5)), 4) AS heat, count(DISTINCT publisher) AS source_count, count(*) AS item_count,
  strftime(min(published_at), {ts}) AS first_at, strftime(max(published_at), {ts}) AS last_at, max({'o': official, 's': coalesce(score, -1), 'p': published_at, 'i': item_id}).i AS item_id FROM items WHERE story_id IS NOT NULL GROUP BY story_id""".replace("{ts}", TS_SQL), True)
def story_stats(spark, sf):
    out = O.story_stats(R.items(spark, sf).where("story_id is not null").withColumn("heat", F.col("value")))
    return out.select("story_id", F.round("heat", 4).alias("heat"), "source_count", "item_count", at("first_at").alias("first_at"), at("last_at").alias("last_at"), "item_id")


@query("A6_item_heat", """SELECT item_id, round(coalesce(CASE WHEN score >= 0 THEN score / 100.0 END, CASE WHEN event_type IN ('insider', 'other') THEN 0.35 ELSE 0.5 END) * CASE WHEN official THEN 1.25 ELSE 1.0 END
  * pow(0.5, greatest(date_diff('minute', published_at, TIMESTAMP '2024-02-01 00:00:00') / 60.0, 0.0) / 18.0), 6) AS heat FROM items""", True)
def heat(spark, sf):
    age = (F.lit(1706745600) - P.seconds("published_at")) / 3600.0
    items = R.items(spark, sf)
    return items.select("item_id", F.round(O.item_heat(F.col("score"), F.col("event_type"), F.col("official"), age), 6).alias("heat"))


@query("A8_mood", """SELECT company, round(CASE WHEN count(*) >= 20 THEN sum(greatest(coalesce(score, 1), 1) * mood) / sum(greatest(coalesce(score, 1), 1)) END, 4) AS mean, count(*) AS n,
  count(*) FILTER (mood > 0) AS up, count(*) FILTER (mood < 0) AS down FROM items WHERE mood IS NOT NULL GROUP BY company""", True)
def mood(spark, sf):
    return O.mood(R.items(spark, sf), "company").select("company", F.round("mean", 4).alias("mean"), "n", "up", "down")


@query("A9_independence", """SELECT independence, count(*) AS n FROM (SELECT CASE WHEN official THEN 'official' WHEN story_id IS NULL OR item_id = min(item_id) OVER (PARTITION BY story_id) THEN 'report' ELSE 'repost' END AS independence FROM items) GROUP BY 1""", True)
def independence(spark, sf):
    return O.independence(R.items(spark, sf)).groupBy("independence").agg(F.count("*").alias("n"))


@query("A10_publishers", "SELECT story_id, count(DISTINCT publisher) AS publishers FROM items WHERE story_id IS NOT NULL GROUP BY story_id HAVING count(DISTINCT publisher) >= 2", True)
def publishers(spark, sf):
    return R.items(spark, sf).where("story_id is not null").groupBy("story_id").agg(F.count_distinct("publisher").alias("publishers")).where("publishers >= 2")


# Joins


@query("J1_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner(spark, sf):
    return T_(spark, sf, "customer").join(T_(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("J2_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left(spark, sf):
    return T_(spark, sf, "customer").join(T_(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("J4_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi(spark, sf):
    return T_(spark, sf, "documents").join(T_(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("J5_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti(spark, sf):
    return S.missing_references(T_(spark, sf, "documents").select("doc_id"), "doc_id", T_(spark, sf, "labels"), "doc_id")


@query("J6_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(spark, sf):
    return P.latest(T_(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("J7_latest_as_of", "SELECT user_id, event_id FROM events WHERE event_id <= (SELECT max(event_id) * 7 // 10 FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_as_of(spark, sf):
    e = T_(spark, sf, "events").select("user_id", "event_id")
    return P.latest_as_of(e, ["user_id"], ["event_id"], F.col("event_id") <= mark(e, 7))


@query("J9_near_in_time", """SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000""")
def near(spark, sf):
    return P.near_pairs(T_(spark, sf, "events"), "user_id", "event_id", "ts", 7200)


@query("J10_shared_grams", """, names AS (SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name), grams AS (SELECT DISTINCT p_partkey, unnest(CASE WHEN len(p_name) = 0 THEN [] ELSE list_transform(range(1, greatest(len(p_name) - 2, 1) + 1), lambda i: substring(p_name, i, 3)) END) AS g FROM names),
  pairs AS (SELECT a.p_partkey AS id, b.p_partkey AS other, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND b.p_partkey < a.p_partkey GROUP BY ALL HAVING count(*) >= 2)
  SELECT id, other, shared FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) <= 5""", True)
def shared_grams(spark, sf):
    parts = T_(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))  # equal titles are one
    return D.shared_grams(parts, "p_partkey", X.trigrams(F.col("p_name")), 5).select("id", "other", "shared")


@query("J12_as_of_join", """SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (o_orderkey % 40000) AS t FROM orders) o
  LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.user_id = o.o_custkey AND v.ts <= o.t ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) e ON true""")
def as_of(spark, sf):
    orders = T_(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey % 40000 as int), 0)").alias("t"))
    events = T_(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return P.as_of_join(orders, events, "user_id", "t", "ts", ["event_id"], "event_id").select("o_orderkey", "event_id")


@query("J13_status_at_sequence", """, ended AS (SELECT user_id, arg_min(event_type, event_id) AS s FROM events WHERE event_type IN ('error', 'purchase') AND event_id <= (SELECT max(event_id) * 6 // 10 FROM events) GROUP BY user_id)
  SELECT c_custkey AS id, coalesce(s, 'open') AS status FROM customer LEFT JOIN ended ON user_id = c_custkey""", True)
def status_at(spark, sf):
    base = T_(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("open").alias("status"))
    ends = T_(spark, sf, "events").where("event_type in ('error', 'purchase')").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return P.status_at(base, ends, mark(T_(spark, sf, "events"), 6))


@query("J18_redirects")
def redirects(spark, sf):
    return D.follow(R.stories(spark, sf).select("story_id", "redirect_to"), "story_id", "redirect_to")


ORACLES["J18_redirects"] = f"""WITH RECURSIVE {R.oracle_items()}, {R.oracle_stories()},
  walk AS (SELECT story_id AS id, story_id AS here, 0 AS depth FROM stories UNION ALL SELECT w.id, s.redirect_to, depth + 1 FROM walk w JOIN stories s ON s.story_id = w.here WHERE s.redirect_to IS NOT NULL AND depth < 70),
  ends AS (SELECT id, arg_max(here, depth) AS here, max(depth) AS depth FROM walk GROUP BY id)
  SELECT id, CASE WHEN depth < 70 THEN here END AS "end", CASE WHEN depth >= 70 THEN 'cycle' WHEN here NOT IN (SELECT story_id FROM stories) THEN 'missing' ELSE 'ok' END AS state FROM ends"""


@query("J22_interval_overlap", """, known AS (SELECT event_id AS id, epoch(ts) AS s, epoch(ts) + 600 AS e FROM events WHERE event_type = 'error'), fresh AS (SELECT event_id AS id, epoch(ts) AS s, epoch(ts) + 900 AS e FROM events WHERE event_type = 'purchase')
  SELECT id FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE f.s < k.e AND f.e > k.s)""", True)
def overlap(spark, sf):
    spans = lambda df, n: df.select(F.col("event_id").alias("id"), P.seconds("ts").alias("started"), (P.seconds("ts") + n).alias("ended"))
    e = T_(spark, sf, "events")
    return P.without_overlap(spans(e.where("event_type = 'purchase'"), 900), spans(e.where("event_type = 'error'"), 600)).select("id")


# Aggregation


@query("A1_conditional_counts", "SELECT l_shipmode, n, returned, open FROM (SELECT l_linestatus AS l_shipmode, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, coalesce(sum(CASE WHEN l_quantity > 25 THEN 1 END), 0)::BIGINT AS open FROM lineitem GROUP BY 1)")
def conditional(spark, sf):
    return T_(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 25).alias("open"))


@query("A2_zero_preserving", "SELECT n_name, count(c_custkey) AS total, count(*) FILTER (c_acctbal > 5000) AS rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def zero_preserving(spark, sf):
    return T_(spark, sf, "nation").join(T_(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("total"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))


@query("A3_mentions", "SELECT company, count(*) AS n FROM items WHERE coalesce(tmt, 1) <> 0 GROUP BY company ORDER BY n DESC, company LIMIT 6", True)
def mentions(spark, sf):
    tagged = O.visible(R.items(spark, sf)).select(F.explode(F.array("company")).alias("company"))
    return tagged.groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(6)


@query("A4_day_rollup", """, days AS (SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' GROUP BY 1),
  spine AS (SELECT unnest(generate_series((SELECT min(day) FROM days)::TIMESTAMP, (SELECT max(day) FROM days)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day),
  filled AS (SELECT spine.day, coalesce(n, 0) AS n, coalesce(users, 0) AS users FROM spine LEFT JOIN days USING (day))
  SELECT strftime(day, '%Y-%m-%d') AS day, n, users, n - lag(n) OVER (ORDER BY day) AS growth FROM filled""", True)
def rollup(spark, sf):
    e = T_(spark, sf, "events").where("event_type = 'error'")
    out = P.day_rollup(e, "ts", {"n": F.count("*"), "users": F.count_distinct("user_id")})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("A13_report_bps", """SELECT l_returnflag, count(*) AS n, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'rejected') AS rejected, (count(*) FILTER (s <> 'pending') * 10000 // count(*))::BIGINT AS decided_bps,
  CASE WHEN count(*) FILTER (s <> 'pending') > 0 THEN (count(*) FILTER (s = 'accepted') * 10000 // count(*) FILTER (s <> 'pending'))::BIGINT END AS acceptance_bps
  FROM (SELECT l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS s FROM lineitem) GROUP BY ROLLUP (l_returnflag)""")
def report_bps(spark, sf):
    status = F.when(F.col("l_linenumber") % 3 == 0, "accepted").when(F.col("l_linenumber") % 3 == 1, "rejected").otherwise("pending")
    return S.report(T_(spark, sf, "lineitem").withColumn("s", status), "l_returnflag", "s").drop("overall")


@query("A16_coverage", "SELECT 'labelled' AS name, count(l.doc_id) AS covered, count(*) AS total, round(100.0 * count(l.doc_id) / count(*), 2) AS percent FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'long', count(*) FILTER (n_chars > 1000), count(*), round(100.0 * count(*) FILTER (n_chars > 1000) / count(*), 2) FROM documents")
def coverage(spark, sf):
    d = O.with_flag(T_(spark, sf, "documents").select("doc_id", "n_chars"), T_(spark, sf, "labels"), "doc_id", "has")
    return M.coverage(d, {"labelled": F.col("has"), "long": F.col("n_chars") > 1000})


@query("A18_per_class", """, l AS (SELECT quality AS a, toxic AS p FROM labels), c AS (SELECT label, count(*) FILTER (k = 0) AS support, count(*) FILTER (k = 1) AS predicted, count(*) FILTER (k = 1 AND r) AS "right" FROM (SELECT a AS label, 0 AS k, a = p AS r FROM l UNION ALL SELECT p, 1, a = p FROM l) GROUP BY label)
  SELECT label, support, predicted, "right", round("right" / nullif(predicted, 0), 6) AS precision, round("right" / nullif(support, 0), 6) AS recall FROM c""", True)
def per_class(spark, sf):
    out = M.per_class(T_(spark, sf, "labels"), "quality", "toxic")
    return out.select("label", "support", "predicted", "right", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("A19_wilson", """, a AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS "right" FROM labels)
  SELECT n, "right", round("right" / n, 6) AS accuracy, round(("right" / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt(("right" / n) * (1 - "right" / n) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n), 6) AS low FROM a""", True)
def wilson(spark, sf):
    return M.accuracy(T_(spark, sf, "labels"), "quality", "toxic").select("n", "right", F.round("accuracy", 6).alias("accuracy"), F.round("low", 6).alias("low"))


@query("A20_kappa", """, x AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) / count(*) AS o, avg(quality) AS p, avg(toxic) AS q FROM labels), y AS (SELECT n, o, p * q + (1 - p) * (1 - q) AS e FROM x)
  SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN e < 1 THEN (o - e) / (1 - e) END, 6) AS kappa FROM y""", True)
def kappa(spark, sf):
    return M.kappa(T_(spark, sf, "labels"), "quality", "toxic").select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


_PROB = "((doc_id * 37) % 1000) / 1000.0"


@query("A23_calibration", f""", p AS (SELECT CAST({_PROB} AS DOUBLE) AS p, quality AS y FROM labels), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS s FROM p GROUP BY 1)
  SELECT round((SELECT sum(n * abs(c - s)) / sum(n) FROM b), 6) AS ece, round((SELECT avg(pow(p - y, 2)) FROM p), 6) AS brier""", True)
def calibration(spark, sf):
    rows = T_(spark, sf, "labels").select(F.expr(f"cast({_PROB} as double)").alias("p"), F.col("quality").alias("y"))
    return M.calibration(rows, "p", "y").select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query("A25_nearest_rank", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank(spark, sf):
    return M.nearest_rank(T_(spark, sf, "events"), "value", ["event_type"])


@query("A27_gate", "SELECT n, n_toxic, CASE WHEN n >= 10 THEN '' ELSE 'enough' END || CASE WHEN n_toxic = 0 THEN '' ELSE 'clean' END AS failed, n >= 10 AND n_toxic = 0 AS passed FROM (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic FROM labels)")
def gate(spark, sf):
    m = T_(spark, sf, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return M.gate(m, {"enough": F.col("n") >= 10, "clean": F.col("n_toxic") == 0})


@query("A28_shadow", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS disagreements, (count(*) FILTER (event_type = 'error') * 10000 // count(*))::BIGINT AS error_bps, (count(*) FILTER (event_type = 'view') * 10000 // count(*))::BIGINT AS disagreement_bps FROM events")
def shadow(spark, sf):
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "disagree").otherwise("agree")
    return M.shadow(T_(spark, sf, "events").withColumn("o", outcome), "o")


@query("A29_daily_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def usage(spark, sf):
    return T_(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("A31_violations", "SELECT 'late_line' AS rule, count(*) FILTER (l_linenumber > 6) AS n FROM lineitem UNION ALL SELECT 'big_discount', count(*) FILTER (l_discount > 0.09) FROM lineitem")
def violations(spark, sf):
    return S.violations(T_(spark, sf, "lineitem"), {"late_line": F.col("l_linenumber") > 6, "big_discount": F.col("l_discount") > 0.09})


@query("A32_chain_faults", """SELECT conv_id, count(*) AS n, min(turn + 1) AS least, max(turn + 1) AS greatest, count(*) FILTER (turn + 1 <> coalesce(p, 0) + 1) AS invalid
  FROM (SELECT conv_id, turn, lag(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id""")
def chain_faults(spark, sf):
    return P.chain_faults(T_(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("version")), "conv_id")


@query("A36_budget", "SELECT event_id, fits FROM (SELECT event_id, coalesce(sum(greatest(v, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + v <= 100 AS fits FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS v FROM events))")
def budget(spark, sf):
    e = T_(spark, sf, "events").select("event_id", "user_id", F.floor("value").cast("bigint").alias("v"))
    return S.budget(e, ["user_id"], "event_id", "v", 100).select("event_id", "fits")


# Windows, gaps, versions, sets


@query("W3_longest_gap", """SELECT user_id, count(*) AS n, round(max(gap), 3) AS longest, round(greatest(43200.0, 1.5 * max(gap)), 3) AS limit_s FROM (SELECT user_id, epoch(t) - lag(epoch(t)) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM (SELECT DISTINCT user_id, date_trunc('minute', ts) AS t FROM events)) GROUP BY user_id HAVING count(*) >= 10""")
def longest_gap(spark, sf):
    return P.longest_gap(T_(spark, sf, "events"), "user_id", "ts").select("user_id", "n", F.round("longest", 3).alias("longest"), F.round("limit_s", 3).alias("limit_s"))


@query("W4_gaps", f"""SELECT event_type, strftime(s, {TS_SQL}) AS started, strftime(ts, {TS_SQL}) AS ended FROM (SELECT event_type, ts, max(ts) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM events) WHERE epoch_us(ts) - epoch_us(s) > 1800000000""")
def gaps(spark, sf):
    return P.gaps(T_(spark, sf, "events"), "event_type", "ts", 1800).select("event_type", at("started").alias("started"), at("ended").alias("ended"))


@query("ST7_sessions", f"""SELECT user_id, strftime(min(ts), {TS_SQL}) AS started, strftime(max(ts), {TS_SQL}) AS ended, count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 86400000000 THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g""")
def sessions(spark, sf):
    return P.islands(T_(spark, sf, "events"), "user_id", "ts", 86400).select("user_id", at("started").alias("started"), at("ended").alias("ended"), "n")


@query("ST11_retry_interval", "SELECT p_partkey, CAST(greatest(p_size, least(p_size * least(pow(2, p_partkey % 6), 8), 360)) AS DOUBLE) AS wait FROM part")
def retry(spark, sf):
    return T_(spark, sf, "part").select("p_partkey", P.retry_interval(F.col("p_size"), F.col("p_partkey") % 6).cast("double").alias("wait"))


@query("ST12_next_due", "SELECT o_orderkey, CASE WHEN o_orderkey > 900 THEN o_orderkey ELSE o_orderkey + (floor((900 - o_orderkey) / 7) + 1)::BIGINT * 7 END AS due FROM orders")
def next_due(spark, sf):
    return T_(spark, sf, "orders").select("o_orderkey", P.next_due(F.col("o_orderkey"), F.lit(900), F.lit(7)).cast("bigint").alias("due"))


@query("ST14_rate_window", f"SELECT strftime(date_trunc('hour', ts), {TS_SQL}) AS hour, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY 1")
def rate_window(spark, sf):
    return T_(spark, sf, "events").groupBy(at(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count("*").alias("n"), (F.count("*") > 3).alias("over"))


@query("ST15_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def retention(spark, sf):
    old = T_(spark, sf, "orders").where("o_orderdate < '1996-01-01'").select("o_orderkey")
    return S.missing_references(old, "o_orderkey", T_(spark, sf, "lineitem").where("l_quantity > 45"), "l_orderkey")


@query("ST16_versions", "SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS version FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def versions(spark, sf):
    return P.changes_only(T_(spark, sf, "events"), "user_id", ["event_id"], "event_type").select("event_id", "event_type", "version")


@query("ST17_idempotent", "SELECT user_id AS key, count(*) AS n, count(DISTINCT event_type) AS payloads, min(event_id) AS first_seq, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id")
def idempotent(spark, sf):
    return S.idempotent(T_(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type"), "key", "event_type")


@query("SY1_changes", "SELECT event_id AS seq, event_type AS kind FROM events WHERE event_id > 100 AND event_id <= (SELECT max(event_id) * 8 // 10 FROM events) AND event_type IN ('click', 'view') ORDER BY event_id LIMIT 60")
def changes(spark, sf):
    log = T_(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return S.changes(log, 100, mark(T_(spark, sf, "events"), 8), ["click", "view"], 60)


_SNAP = "snap AS (SELECT concat('r', user_id) AS resource, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE event_type END AS kind FROM events WHERE event_id <= (SELECT max(event_id) * 9 // 10 FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


def _log(spark, sf):
    e = T_(spark, sf, "events")
    return e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("resource"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise(F.col("event_type")).alias("kind"))


@query("SY2_snapshot", f"WITH {_SNAP} SELECT resource, seq, kind FROM snap WHERE kind <> 'delete'")
def snapshot(spark, sf):
    return S.snapshot(_log(spark, sf), mark(T_(spark, sf, "events"), 9))


@query("SY2_pages", f"WITH {_SNAP}, placed AS (SELECT (row_number() OVER (ORDER BY resource) - 1) // 50 AS page, resource, resource || ':' || seq AS r FROM snap WHERE kind <> 'delete') SELECT page, count(*) AS n, sha256('[' || string_agg(r, ',' ORDER BY resource) || ']') AS sha256 FROM placed GROUP BY page")
def snapshot_pages(spark, sf):
    return S.pages(S.snapshot(_log(spark, sf), mark(T_(spark, sf, "events"), 9)), 50, F.concat_ws(":", "resource", "seq"))


@query("SY3_apply_changes", "SELECT user_id, event_id AS seq FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def apply_changes(spark, sf):
    e = T_(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"))
    return S.apply_changes(e.where((F.col("seq") <= mark(T_(spark, sf, "events"), 3)) & (F.col("op") == "update")).groupBy("user_id").agg(F.max("seq").alias("seq")), e, "user_id")


@query("U2_merge_by_url", "SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS key, min(page_id) AS id, count(*) AS n FROM pages GROUP BY 1")
def merge_by_url(spark, sf):
    pages = T_(spark, sf, "pages").select("page_id", X.canonical_url(F.col("url")).alias("u"), F.lit("x").alias("tag"))
    return D.merge_by(pages, F.col("u"), "page_id", "page_id", "tag").select("key", "id", "n")


@query("U3_repeats", """SELECT event_id, first_id FROM (SELECT event_id, arg_min(event_id, (t, event_id)) OVER w AS first_id FROM (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS t FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)) WHERE first_id <> event_id""")
def repeated(spark, sf):
    return D.repeats(T_(spark, sf, "events"), ["user_id", "event_type"], "event_id", "ts", 7).select("event_id", "first_id")


@query("U4_donors", """, e AS (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS t, event_id % 3 = 0 AS judged FROM events)
  SELECT a.event_id, (SELECT arg_min(b.event_id, (b.t, b.event_id)) FROM e b WHERE b.user_id = a.user_id AND b.judged AND abs(b.t - a.t) <= 86400) AS donor FROM e a WHERE NOT judged AND donor IS NOT NULL""", True)
def donors(spark, sf):
    return D.donors(T_(spark, sf, "events"), ["user_id"], "event_id", "ts", F.col("event_id") % 3 == 0, 24).select("event_id", "donor")


@query("U7_fold", "SELECT lang, doc_id, others FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY lang, source) - 1 AS others FROM documents) WHERE r = 1")
def fold(spark, sf):
    d = T_(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.concat_ws("|", "lang", "source").alias("g"))
    return D.fold_groups(d, [F.col("n_chars").desc(), F.col("doc_id")], "doc_id", "g").select("lang", "doc_id", "others")


@query("U8_components", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, CASE WHEN event_type = 'error' THEN 20000000 + user_id // 50 ELSE 10000000 + user_id // 5 END AS b FROM events), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a) SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def components(spark, sf):
    e = T_(spark, sf, "events").select(F.col("user_id").alias("a"), F.expr("case when event_type = 'error' then 20000000 + user_id div 50 else 10000000 + user_id div 5 end").alias("b")).distinct()
    return D.components(e)


@query("U9_leaks", "SELECT lang, count(DISTINCT source) AS splits, count(*) AS n FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1")
def leaks(spark, sf):
    return D.leaks(T_(spark, sf, "documents"), "lang", "source")


@query("U10_hash_split", "SELECT doc_id, CASE WHEN d < 60 THEN 'train' WHEN d < 80 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, concat('0x', substring(sha256('s:' || doc_id), 1, 8))::BIGINT % 100 AS d FROM documents)")
def hash_split(spark, sf):
    return D.hash_split(T_(spark, sf, "documents"), F.col("doc_id").cast("string"), "s", {"train": 60, "dev": 20, "test": 20}).select("doc_id", "split")


@query("W7_round_robin", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('q:' || doc_id), doc_id) AS r FROM documents) ORDER BY r, sha256('q:' || source), doc_id LIMIT 90")
def round_robin(spark, sf):
    return S.round_robin(T_(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", "q", 90).select("doc_id")


@query("W8_sample_per_stratum", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('k:' || doc_id), doc_id) <= 3")
def per_stratum(spark, sf):
    return S.sample_per_stratum(T_(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", "k", 3).select("doc_id", "source")


@query("X2_reconcile", "SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'retire' WHEN a.v = b.v THEN 'keep' ELSE 'update' END AS action FROM (SELECT user_id AS k, count(*) % 3 AS v FROM events GROUP BY user_id) a FULL JOIN (SELECT c_custkey AS k, c_nationkey % 3 AS v FROM customer) b ON a.k = b.k")
def reconcile(spark, sf):
    have = T_(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg((F.count("*") % 3).cast("bigint").alias("v"))
    want = T_(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") % 3).cast("bigint").alias("v"))
    return S.reconcile(have, want, "key", ["v"])


# Scalar functions


@query("F3_canonical_url", "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u FROM pages")
def canonical(spark, sf):
    return T_(spark, sf, "pages").select("page_id", X.canonical_url(F.col("url")).alias("u"))


@query("F7_trigrams", "SELECT p_partkey, len(list_distinct(list_transform(range(1, greatest(len(p_name) - 2, 1) + 1), lambda i: substring(p_name, i, 3))))::INT AS n FROM part")
def trigram_count(spark, sf):
    return T_(spark, sf, "part").select("p_partkey", F.size(X.trigrams(F.col("p_name"))).alias("n"))


@query("F8_numbers", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)*'))), ',') AS numbers FROM documents")
def number_set(spark, sf):
    return T_(spark, sf, "documents").select("doc_id", F.array_join(X.numbers(F.col("text")), ",").alias("numbers"))


@query("F17_quarter", "SELECT o_orderkey, concat(year(o_orderdate), '-Q', quarter(o_orderdate)) AS bucket FROM orders")
def quarter(spark, sf):
    return T_(spark, sf, "orders").select("o_orderkey", X.quarter_bucket(F.col("o_orderdate")).alias("bucket"))


@query("F19_language_guess", "SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END AS guess FROM documents")
def guess(spark, sf):
    return T_(spark, sf, "documents").select("doc_id", X.language_guess(F.col("text")).alias("guess"))


@query("F27_json_hash", "SELECT c_custkey, sha256('{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}') AS sha FROM customer")
def json_hash(spark, sf):
    fact = F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"), F.lit(1).alias("seen"))
    return T_(spark, sf, "customer").select("c_custkey", X.fact_signature(fact, ["seen"], ["name", "key", "seen"]).alias("sha"))


@query("F28_hash_bucket", "SELECT doc_id, (concat('0x', substring(sha256(doc_id || chr(0) || 'k'), 1, 16))::UBIGINT % 10000)::INT AS bucket FROM documents")
def hash_bucket(spark, sf):
    return T_(spark, sf, "documents").select("doc_id", X.bucket(F.col("doc_id").cast("string"), "k").alias("bucket"))


@query("F30_company_number", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def company_number(spark, sf):
    return T_(spark, sf, "customer").select("c_custkey", X.company_number(F.col("c_custkey")).alias("cik"))


@query("F34_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return T_(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("F36_visible_text")
def visible_text(spark, sf):
    return T_(spark, sf, "pages").select("page_id", X.visible_text(F.col("html")).alias("text"))


@query("SC3_flash_title")
def flash_title(spark, sf):
    return T_(spark, sf, "conversations").select("conv_id", "turn", X.flash_title(F.col("text")).alias("title"))


@query("D23_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ther') ORDER BY doc_id LIMIT 51")
def search(spark, sf):
    hits = T_(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("ther"))).select("doc_id")
    return O.page(hits, [F.col("doc_id")], 50)


@query("D20_digest", "SELECT channel, item_id, rank::INT AS rank FROM (SELECT channel, item_id, row_number() OVER (PARTITION BY channel ORDER BY coalesce(score, 50) DESC, item_id DESC) AS rank FROM items WHERE coalesce(tmt, 1) <> 0 AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-11') WHERE rank <= 20", True)
def digest(spark, sf):
    day = O.visible(R.items(spark, sf)).where("published_at >= '2024-01-10' and published_at < '2024-01-11'")
    return O.top_per_group(day, "channel", [F.coalesce("score", F.lit(50)).desc(), F.col("item_id").desc()], 20).select("channel", "item_id", "rank")
