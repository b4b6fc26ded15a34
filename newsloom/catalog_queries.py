"""Registered queries on sources, catalogues, incremental state, samples, reviews and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .functions import titles as T
from .operators import catalog as K
from .operators import dedup as D
from .operators import evaluation as E
from .operators import feed as O
from .operators import review as V
from .operators import state as A
from .operators import stats as M
from .operators import sync as S
from .operators import temporal as P
from .queries import T_, TS, TS_SQL, at, query
from .sources import tables as R
from .story_queries import NEWS, news

_T0 = "TIMESTAMP '2024-01-20 00:00:00'"


def lit_ts(text: str):
    return F.lit(text).cast("timestamp")


# Sources


_FEED = "'<rss>' || string_agg('<item><title>News &amp;amp; views ' || event_id || '</title><link>http://x/' || event_id || '</link><pubDate>' || strftime(ts, '%Y-%m-%d') || '</pubDate><description>&lt;p&gt;Event ' || event_type || '&lt;/p&gt;</description></item>', '' ORDER BY event_id) || '</rss>'"


@query("SC1_feed_entries", "SELECT user_id, (r - 1)::INT AS position, 'News & views ' || event_id AS title, 'http://x/' || event_id AS link, strftime(ts, '%Y-%m-%d') AS published, 'Event ' || event_type AS summary FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 60")
def feed_entries(spark, sf):
    i = F.col("event_id").cast("string")
    item = F.concat(F.lit("<item><title>News &amp;amp; views "), i, F.lit("</title><link>http://x/"), i, F.lit("</link><pubDate>"), F.date_format("ts", "yyyy-MM-dd"), F.lit("</pubDate><description>&lt;p&gt;Event "), F.col("event_type"), F.lit("&lt;/p&gt;</description></item>"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda x: x["x"])
    feeds = T_(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("<rss>"), F.array_join(each, ""), F.lit("</rss>")).alias("xml"))
    return K.feed_entries(feeds, "xml")


@query("SC2_cursor_pages", "SELECT event_type AS wire, (r - 1) // 100 AS page, event_id AS item, CASE WHEN r = max(r) OVER (PARTITION BY event_type, (r - 1) // 100) THEN event_id END AS next_cursor FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events)")
def cursor_pages(spark, sf):
    """Landed JSON pages of a wire back to items; the last item of a page is the cursor of the next."""
    from pyspark.sql import Window

    ranked = T_(spark, sf, "events").withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("event_id").desc())))
    landed = ranked.groupBy(F.col("event_type").alias("wire"), F.floor((F.col("r") - 1) / 100).cast("bigint").alias("page")).agg(F.to_json(F.struct(F.min("event_id").alias("next_cursor"), F.collect_list(F.struct("event_id")).alias("items"))).alias("body"))
    read = landed.select("wire", "page", F.from_json("body", "next_cursor long, items array<struct<event_id long>>").alias("b")).select("wire", "page", "b.next_cursor", F.explode("b.items.event_id").alias("item"))
    return read.withColumn("next_cursor", F.when(F.col("item") == F.col("next_cursor"), F.col("next_cursor")))


@query("SC4_without_counters", "SELECT count(DISTINCT (user_id, event_type))::BIGINT AS records, count(*) AS sightings FROM events")
def without_counters(spark, sf):
    e = T_(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("read_count"), F.col("event_id").alias("share_count"))
    return e.select(K.without_counters(e, ["read_count", "share_count"]).alias("sha")).agg(F.count_distinct("sha").alias("records"), F.count("*").alias("sightings"))


@query("SC5_query_news", "SELECT event_id, 'Acme rises ' || event_id AS clean FROM events WHERE event_id % 4 = 0")
def query_news(spark, sf):
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    title = F.when(k == 0, F.concat(F.lit("Acme rises "), i, F.lit(" - Some Paper"))).when(k == 1, F.lit("Acme (NASDAQ: ACM) stock quote today - Site")).when(k == 2, F.concat(F.lit("Acme thread "), i)).otherwise(F.lit("Acmeville opens - Paper"))
    entries = T_(spark, sf, "events").select("event_id", title.alias("title"), F.when(k == 2, "https://www.reddit.com/r/x").otherwise("https://a.b/c").alias("url"))
    return K.query_news(entries, F.array(F.lit("Acme"), F.lit("ACM Corp"))).select("event_id", "clean")


@query("SC6_filing_types", "SELECT event_id, ['earnings', 'officer_change', 'other', 'other', 'material_agreement'][event_id % 5 + 1] AS type, event_id % 5 IN (2, 3) AS routine FROM events")
def filing_types(spark, sf):
    codes = F.element_at(F.array(*[F.lit(x) for x in ("9.01, 2.02", "5.02,9.01", "9.01", "7.01 , 9.01", "1.01,12.02")]), (F.col("event_id") % 5 + 1).cast("int"))
    kind, routine = K.filing_type(codes, {"2.02": "earnings", "5.02": "officer_change", "1.01": "material_agreement"})
    return T_(spark, sf, "events").select("event_id", kind.alias("type"), routine.alias("routine"))


@query("SC7_new_filings", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def new_filings(spark, sf):
    return S.missing_references(T_(spark, sf, "orders").select("o_orderkey"), "o_orderkey", T_(spark, sf, "lineitem").where("l_linenumber = 4").select("l_orderkey").distinct(), "l_orderkey")


@query("SC8_exchange_headlines", "SELECT event_id, ['Announcements', 'Announcements', '', 'Circulars'][event_id % 4 + 1] AS grp, ['results', 'dividend', 'buyback', 'other'][event_id % 4 + 1] AS type FROM events")
def exchange_headlines(spark, sf):
    h = F.element_at(F.array(*[F.lit(x) for x in ("Announcements - [Final Results / Dividend]", "Announcements - [Dividend]", "Share Buyback report", "Circulars - [Other]")]), (F.col("event_id") % 4 + 1).cast("int"))
    group, _ = K.category(h)
    return T_(spark, sf, "events").select("event_id", group.alias("grp"), K.classified(h, {"Final Results": "results", "Dividend": "dividend"}, {"buyback": "buyback"}).alias("type"))


@query("SC9_links", "SELECT page_id, href, title FROM (SELECT page_id, href, title, row_number() OVER (PARTITION BY page_id ORDER BY p) AS r FROM (SELECT page_id, href, arg_min(title, p) AS title, min(p) AS p FROM (SELECT page_id, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]+)\"[^>]*>([^<]*)</a>', 1), 1) AS p, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]+)\"[^>]*>([^<]*)</a>', 1)) AS href, trim(unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]+)\"[^>]*>([^<]*)</a>', 2))) AS title FROM pages) WHERE starts_with(href, '/') AND len(title) >= 8 GROUP BY ALL)) WHERE r <= 40")
def links(spark, sf):
    return K.links(T_(spark, sf, "pages").select("page_id", "html"), "html", "^/")


@query("SC10_source_registry", "SELECT 'static:' || event_type AS key, 'rss' AS type FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'google:' || c_custkey, 'googlenews' FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'nasdaq:' || c_custkey, 'rss' FROM customer WHERE c_mktsegment = 'BUILDING'")
def registry(spark, sf):
    c = T_(spark, sf, "customer")
    named = lambda df, prefix, column, kind: df.select(F.concat(F.lit(prefix + ":"), F.col(column).cast("string")).alias("key"), F.lit(kind).alias("type"))
    return named(T_(spark, sf, "events").select("event_type").distinct(), "static", "event_type", "rss").unionByName(named(c.where("c_acctbal > 5000"), "google", "c_custkey", "googlenews")).unionByName(named(c.where("c_mktsegment = 'BUILDING'"), "nasdaq", "c_custkey", "rss"))


@query("SC11_security_master", "SELECT cik, ticker, market_cap, industry FROM (SELECT lpad((o_custkey)::VARCHAR, 10, '0') AS cik, arg_min('T-' || (o_orderkey % 300), o_orderkey) AS ticker FROM orders GROUP BY o_custkey) LEFT JOIN (SELECT 'T-' || p_partkey AS ticker, (p_size * 1000)::DOUBLE AS market_cap, p_type AS industry FROM part WHERE p_partkey < 200) USING (ticker)")
def security_master(spark, sf):
    listings = T_(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit(" t."), (F.col("o_orderkey") % 300).cast("string")).alias("ticker"), F.lit("n").alias("name"))
    screener = T_(spark, sf, "part").where("p_partkey < 200").select(F.concat(F.lit("T/"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat(F.lit("$"), F.format_number(F.col("p_size") * 1000, 2)).alias("market_cap"), F.col("p_type").alias("industry"))
    return K.security_master(listings, screener).select("cik", "ticker", "market_cap", "industry")


@query("SC11_replaced", "SELECT c_custkey AS k, 'removed' AS change, true AS accepted FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE value > 20) UNION ALL SELECT DISTINCT user_id, 'added', true FROM events WHERE value > 20 AND user_id NOT IN (SELECT c_custkey FROM customer)")
def replaced(spark, sf):
    return K.replaced(T_(spark, sf, "customer").select(F.col("c_custkey").alias("k")), T_(spark, sf, "events").where("value > 20").select(F.col("user_id").alias("k")).distinct(), "k", 10)


@query("SC12_worklist", f"SELECT item_id, strftime(published_at, {TS_SQL}) AS published_at FROM (SELECT i.item_id, i.published_at FROM items i LEFT JOIN (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'retry' ELSE 'done' END AS status, ts + INTERVAL 1 DAY AS retry_at FROM events WHERE event_id % 5 < 3) t ON t.event_id = i.item_id WHERE published_at >= TIMESTAMP '2024-01-10' AND (status IS NULL OR status = 'retry' AND retry_at <= {_T0}) ORDER BY i.published_at DESC, item_id DESC LIMIT 200)", True)
def worklist(spark, sf):
    texts = T_(spark, sf, "events").where("event_id % 5 < 3").select(F.col("event_id").alias("item_id"), F.when(F.col("event_id") % 3 == 0, "retry").otherwise("done").alias("status"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("retry_at"))
    return K.worklist(R.items(spark, sf), texts, lit_ts("2024-01-20"), lit_ts("2024-01-10"), 200).select("item_id", at("published_at").alias("published_at"))


@query("SK1_by_hash", "SELECT substr(sha256(o_comment), 1, 2) AS shard, count(DISTINCT o_comment) AS n FROM (SELECT 'order ' || o_custkey AS o_comment FROM orders) GROUP BY 1")
def by_hash(spark, sf):
    """Payloads written by their hash and read back."""
    import uuid

    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/by-hash-" + uuid.uuid4().hex
    R.write_by_hash(T_(spark, sf, "orders").select(F.concat(F.lit("order "), F.col("o_custkey").cast("string")).alias("payload")), folder)
    return spark.read.schema("sha256 string, payload string, shard string").parquet(folder).where(F.sha2(F.col("payload").cast("binary"), 256) == F.col("sha256")).groupBy("shard").agg(F.count("*").alias("n"))


@query("SK2_upsert", "SELECT coalesce(c.c_custkey, e.user_id) AS k, coalesce(e.n, c.c_nationkey)::BIGINT AS n, coalesce(c.c_name, 'user') AS name FROM customer c FULL JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey")
def upsert(spark, sf):
    target = T_(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("n"), F.col("c_name").alias("name"))
    incoming = T_(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n")).withColumn("name", F.lit("user"))
    return K.upsert(target, incoming, "k", ["n"], ["name"])


# Predicates and overlays


@query("P3_overlay", """, p AS (SELECT event_id AS item_id, event_type AS st, value FROM events WHERE event_id % 2 = 0)
  SELECT i.item_id, CASE WHEN p.item_id IS NULL THEN i.score WHEN p.st IN ('view', 'click') THEN floor(p.value)::INT END AS score, CASE WHEN p.item_id IS NULL THEN 'legacy' WHEN p.st IN ('view', 'click') THEN 'curated' ELSE 'unusable' END AS score_state FROM items i LEFT JOIN p USING (item_id)""", True)
def overlay(spark, sf):
    e = T_(spark, sf, "events").where("event_id % 2 = 0")
    pointers = e.select(F.col("event_id").alias("item_id"), F.lit("importance").alias("kind"), (F.col("event_id") * 10).alias("publication_id"))
    publications = e.where("event_type <> 'error'").select((F.col("event_id") * 10).alias("publication_id"), F.when(F.col("event_type").isin("view", "click"), "published").otherwise("withdrawn").alias("status"), F.floor("value").cast("int").alias("value"))
    return K.overlay(R.items(spark, sf), "item_id", pointers, publications, {"importance": "score"}).select("item_id", "score", "score_state")


@query("J3_pointer_chain", """, p AS (SELECT event_id AS item_id, event_type AS st, value FROM events)
  SELECT i.item_id, CASE WHEN i.item_id % 2 = 1 THEN i.score WHEN p.st = 'view' THEN floor(p.value)::INT END AS score, CASE WHEN i.item_id % 3 > 0 THEN i.mood WHEN p.st = 'view' THEN floor(p.value)::INT END AS mood, CASE WHEN i.item_id % 5 > 0 THEN i.tmt WHEN p.st = 'view' THEN floor(p.value)::INT END AS tmt FROM items i JOIN p USING (item_id)""", True)
def pointer_chain(spark, sf):
    e = T_(spark, sf, "events")
    kinds = {"importance": ("score", 2), "tone": ("mood", 3), "relevance": ("tmt", 5)}
    pointers = None
    for kind, (_, by) in kinds.items():
        one = e.where(F.col("event_id") % by == 0).select(F.col("event_id").alias("item_id"), F.lit(kind).alias("kind"), F.col("event_id").alias("publication_id"))
        pointers = one if pointers is None else pointers.union(one)
    publications = e.select(F.col("event_id").alias("publication_id"), F.when(F.col("event_type") == "view", "published").otherwise("draft").alias("status"), F.floor("value").cast("int").alias("value"))
    return K.overlay(R.items(spark, sf), "item_id", pointers, publications, {k: c for k, (c, _) in kinds.items()}).select("item_id", "score", "mood", "tmt")


@query("P5_story_members", "SELECT story_id FROM stories WHERE EXISTS (SELECT 1 FROM items i WHERE i.story_id = stories.story_id AND channel = 'ai' AND score >= 70)", True)
def story_members(spark, sf):
    return K.with_member(R.stories(spark, sf), R.items(spark, sf), (F.col("channel") == "ai") & (F.col("score") >= 70)).select("story_id")


@query("P9_routine", "SELECT event_id, event_id % 3 = 0 AS routine, CASE WHEN event_id % 3 = 0 THEN 25 ELSE floor(value)::INT END AS score FROM events")
def routine(spark, sf):
    codes = F.when(F.col("event_id") % 3 == 0, "9.01").otherwise("2.02,9.01")
    _, flag = K.filing_type(codes, {"2.02": "earnings"})
    return T_(spark, sf, "events").select("event_id", flag.alias("routine"), F.when(flag, 25).otherwise(F.floor("value").cast("int")).alias("score"))


@query("P13_optional", "SELECT item_id FROM items WHERE channel = 'ai'", True)
def optional(spark, sf):
    return R.items(spark, sf).where(K.optional(F.col("channel"), "ai") & K.optional(F.col("event_type"), None)).select("item_id")


@query("P14_members", "SELECT user_id FROM events GROUP BY user_id HAVING list_contains(list(event_type), 'error') AND count(*) FILTER (value > 90) > 0")
def array_members(spark, sf):
    by = T_(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"), F.max("value").alias("most"))
    return by.where(F.array_contains("types", "error") & (F.col("most") > 90)).select("user_id")


@query("D17_contracts", """SELECT event_id, ['', 'missing:score', 'type:score', 'choice:label', 'unknown', 'object'][event_id % 6 + 1] AS faults FROM events""")
def contracts(spark, sf):
    cases = ('{"score": 5, "label": "keep"}', '{"label": "keep"}', '{"score": "x", "label": "drop"}', '{"score": 1, "label": "maybe"}', '{"score": 1, "label": "keep", "note": "z"}', "[1]")
    payload = F.element_at(F.array(*[F.lit(x) for x in cases]), (F.col("event_id") % 6 + 1).cast("int"))
    return T_(spark, sf, "events").select("event_id", F.array_join(F.when(payload == "[1]", F.array(F.lit("object"))).otherwise(K.contract_faults(payload, {"score": "int", "label": "string"}, {"label": ["keep", "drop"]})), ",").alias("faults"))


# Catalogues


@query("D15_catalog_sync", "SELECT c_custkey AS k, 2 AS version FROM customer WHERE c_nationkey % 3 <> c_nationkey % 4 AND c_acctbal > 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal <= 0")
def catalog_sync(spark, sf):
    c = T_(spark, sf, "customer")
    old = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 3).cast("bigint").alias("v"))
    current = old.withColumn("sha", K.canonical(old, ["v"])).withColumn("version", F.lit(1))
    return K.append_versions(current, c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") % 4).otherwise(F.col("c_nationkey")).cast("bigint").alias("v")), "k", ["v"]).select("k", "version")


@query("X40_assertions", "SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 50)")
def assertions(spark, sf):
    e = T_(spark, sf, "events")
    return K.new_assertions(e.where("value > 50").select("user_id", "event_type").distinct(), e, ["user_id", "event_type"])


@query("J17_fallback", "SELECT c_custkey AS k, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), (SELECT max(event_id) FROM events WHERE user_id = c_custkey)) AS v FROM customer")
def fallback(spark, sf):
    first = T_(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    second = T_(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("v"))
    return K.fallback(T_(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k", first, second, "v")


@query("J19_merge_chain", "SELECT c_custkey AS id, c_custkey % 10 AS final, 'ok' AS state FROM customer")
def merge_chain(spark, sf):
    """Events merged one into another, ten apart, down to the first of each row."""
    k = F.col("c_custkey")
    return D.follow(T_(spark, sf, "customer").select(k.alias("id"), F.when(k >= 10, k - 10).alias("into")), "id", "into").select("id", F.col("end").alias("final"), "state")


@query("J21_identifiers", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '7'")
def identifiers(spark, sf):
    e = T_(spark, sf, "events")
    ids = e.select(F.col("user_id").alias("entity_id"), F.lit("cik").alias("scheme"), F.col("event_type").alias("value"), F.col("props").alias("qualifiers"))
    return K.identified(e.select(F.col("user_id").alias("entity_id")).distinct(), ids, "cik", "click", "k", "7").select(F.col("entity_id").alias("user_id"))


@query("J23_lineage", "SELECT r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name")
def lineage(spark, sf):
    t = lambda n: T_(spark, sf, n)
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("r_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("D31_list_as_of", "SELECT user_id, event_id AS version FROM (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error' AND user_id > 10 ORDER BY user_id LIMIT 50")
def list_as_of(spark, sf):
    v = T_(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), "event_type", "ts")
    return K.list_as_of(v, "user_id", F.col("ts") <= lit_ts("2024-01-20"), F.col("event_type") != "error", 10, 50).select("user_id", "version")


@query("X3_stale_hashes", "SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0")
def stale_hashes(spark, sf):
    c = T_(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    stored = c.withColumn("sha", F.when(F.col("c_nationkey") % 5 == 0, F.lit("0" * 64)).otherwise(K.canonical(c, ["c_custkey", "c_name"])))
    return K.stale_hashes(stored, ["c_custkey", "c_name"], "sha").select("c_custkey")


@query("X4_pick_time", "SELECT user_id, coalesce(min(event_id) FILTER (event_type <> 'error'), min(event_id)) AS ordinal, CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'valid' ELSE 'invalid' END AS status FROM events GROUP BY user_id")
def pick_time(spark, sf):
    values = T_(spark, sf, "events").select("user_id", F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "invalid").otherwise("valid").alias("status"), F.col("ts").alias("utc"))
    return K.pick_time(values, "user_id").select("user_id", "ordinal", "status")


@query("X28_missing_ids", "SELECT c_custkey AS company, 't' || c_custkey AS ticker, min(o_orderkey)::VARCHAR AS cik FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY c_custkey HAVING count(DISTINCT o_orderkey) = 1")
def missing_ids(spark, sf):
    companies = T_(spark, sf, "customer").select(F.col("c_custkey").alias("company"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"), F.when(F.col("c_acctbal") >= 0, "known").alias("cik"))
    listings = T_(spark, sf, "orders").select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("ticker"), F.col("o_orderkey").cast("string").alias("cik"))
    return K.missing_ids(companies, listings)


@query("X29_missed_items", "SELECT c_custkey AS company, (SELECT count(*) FROM events WHERE user_id = c_custkey AND ts >= TIMESTAMP '2024-01-29') AS media_24h, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey NOT IN (SELECT event_id FROM events)) AS missed FROM customer")
def missed_items(spark, sf):
    c = T_(spark, sf, "customer").select(F.col("c_custkey").alias("company"))
    recent = T_(spark, sf, "events").where(F.col("ts") >= lit_ts("2024-01-29")).groupBy(F.col("user_id").alias("company")).agg(F.count("*").alias("media_24h"))
    lost = S.missing_references(T_(spark, sf, "orders").select(F.col("o_custkey").alias("company"), "o_orderkey"), "o_orderkey", T_(spark, sf, "events").select("event_id"), "event_id")
    return c.join(recent, "company", "left").join(lost.groupBy("company").agg(F.count("*").alias("missed")), "company", "left").fillna(0)


@query("X30_source_changes", "SELECT coalesce(s.k, c.k) AS key, CASE WHEN s.k IS NULL THEN 'add' WHEN c.k IS NULL THEN CASE WHEN s.e THEN 'disable' ELSE 'keep' END WHEN NOT s.e THEN 'enable' WHEN s.ch <> c.ch THEN 'reclassify' ELSE 'keep' END AS action FROM (SELECT c_custkey AS k, c_nationkey % 3 AS ch, c_acctbal > 0 AS e FROM customer) s FULL JOIN (SELECT user_id AS k, min(event_id) % 3 AS ch FROM events GROUP BY user_id) c ON s.k = c.k")
def source_changes(spark, sf):
    stored = T_(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") % 3).cast("bigint").alias("channel"), (F.col("c_acctbal") > 0).alias("enabled"))
    configured = T_(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg((F.min("event_id") % 3).cast("bigint").alias("channel"))
    return K.source_changes(stored, configured)


# Incremental state


@query("ST1_changed_keys", "SELECT user_id AS k, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'gone' ELSE 'changed' END AS change FROM (SELECT user_id, max(event_id) FILTER (event_id <= (SELECT max(event_id) * 9 // 10 FROM events) AND event_type <> 'view') AS a, max(event_id) FILTER (event_type <> 'error') AS b FROM events GROUP BY user_id) WHERE a IS DISTINCT FROM b")
def changed_keys(spark, sf):
    from .queries import mark

    e = T_(spark, sf, "events")
    last = lambda df: df.groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("seq"))
    return A.changed_keys(last(e.where((F.col("event_id") <= mark(e, 9)) & (F.col("event_type") != "view"))), last(e.where("event_type <> 'error'")), "k", ["seq"])


@query("ST2_chunks", "SELECT (r - 1) // 1500 AS chunk, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) GROUP BY 1")
def chunks(spark, sf):
    return A.chunks(T_(spark, sf, "events").select("event_id"), "event_id", 1500).groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("ST3_publishable", "SELECT user_id AS k, CASE WHEN r IS NULL THEN 'unbuilt' ELSE 'changed' END AS why FROM (SELECT user_id, max(event_id) AS last, max(event_id) FILTER (event_type = 'view') AS r FROM events GROUP BY user_id) WHERE r IS NULL OR last > r")
def publishable(spark, sf):
    e = T_(spark, sf, "events").withColumnRenamed("user_id", "k")
    built = e.where("event_type = 'view'").groupBy("k").agg(F.max("event_id").alias("read_at"))
    return A.publishable(built, e.select("k"), "k", "read_at", e.select("k", F.col("event_id").alias("changed_at")))


@query("ST4_readiness", "SELECT (SELECT count(*) FROM events WHERE value < 0) AS dirty, (SELECT count(*) FROM events) AS wanted, (SELECT count(*) FROM events WHERE event_type <> 'error') AS have, 'counts' AS state")
def readiness(spark, sf):
    e = T_(spark, sf, "events")
    return A.readiness(spark.createDataFrame([("ready",)], "status string"), e.where("value < 0"), e, e.where("event_type <> 'error'"))


@query("ST5_catch_up", "SELECT event_type AS source, least(coalesce(min(page) FILTER (event_id % 1000 = 0 OR ts < TIMESTAMP '2024-01-25'), max(page)), 20)::INT AS pages, count(*) FILTER (event_id % 1000 = 0 OR ts < TIMESTAMP '2024-01-25') > 0 AS met FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1) // 20 + 1 AS page FROM events) GROUP BY event_type")
def catch_up(spark, sf):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("event_id").desc()))
    listing = T_(spark, sf, "events").select(F.col("event_type").alias("source"), (F.floor((r - 1) / 20) + 1).cast("int").alias("page"), F.col("event_id").alias("item"), F.col("ts").alias("at"))
    known = T_(spark, sf, "events").where("event_id % 1000 = 0").select(F.col("event_type").alias("source"), F.col("event_id").alias("item"))
    return A.pages_needed(listing, known, lit_ts("2024-01-25"))


@query("ST6_future", "SELECT event_id, event_id % 4 = 0 AS future_suspect FROM events")
def future(spark, sf):
    from .streaming.streams import late_flag

    e = T_(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("observed", F.when(F.col("event_id") % 4 == 0, F.col("ts") - F.expr("INTERVAL 11 MINUTES")).otherwise(F.col("ts") - F.expr("INTERVAL 10 MINUTES")))
    return late_flag(e, "ts", "observed").select("event_id", "future_suspect")


@query("ST8_outages", f"""SELECT user_id, strftime(started, {TS_SQL}) AS started, strftime(ended, {TS_SQL}) AS ended FROM (SELECT user_id, run, min(ts) FILTER (bad) AS started, min(ts) FILTER (NOT bad) AS ended FROM (SELECT *, sum(CASE WHEN bad AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run
  FROM (SELECT user_id, ts, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) WHERE run > 0 GROUP BY user_id, run) WHERE epoch_us(coalesce(ended, TIMESTAMP '2024-02-01')) - epoch_us(started) >= 1800000000""")
def outages(spark, sf):
    rounds = T_(spark, sf, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    out = A.outages(rounds, "user_id", "ts", "ok", F.lit("2024-02-01").cast(rounds.schema["ts"].dataType), 1800)
    return out.select("user_id", F.date_format("started", TS).alias("started"), F.date_format("ended", TS).alias("ended"))


@query("ST9_periods", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'open' ELSE 'close' END AS action FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT user_id AS k FROM events WHERE value > 30) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def periods(spark, sf):
    return A.period_changes(T_(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), T_(spark, sf, "events").where("value > 30").select(F.col("user_id").alias("k")), "k")


def _jobs(spark, sf):
    kinds = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "done").otherwise("enqueue")
    return T_(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), kinds.alias("kind"), F.col("event_id").alias("at"))


_JOBS = """, l AS (SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'done' ELSE 'enqueue' END AS kind, event_id AS t FROM events),
  d AS (SELECT job, min(seq) FILTER (kind = 'done') AS done FROM l GROUP BY job), b AS (SELECT l.job, arg_max(kind, seq) AS kind, arg_max(t, seq) AS t, count(*) FILTER (kind = 'claim') AS claims FROM l JOIN d ON l.job = d.job WHERE done IS NULL OR seq <= done GROUP BY l.job),
  f AS (SELECT *, kind IN ('claim', 'renew') AND t + 100 <= 900 AS lapsed FROM b),
  jobs AS (SELECT job, CASE WHEN kind = 'done' THEN 'done' WHEN (kind = 'fail' OR lapsed) AND claims >= 5 THEN 'dead' WHEN kind = 'fail' OR lapsed THEN 'retry' WHEN kind IN ('claim', 'renew') THEN 'leased' ELSE 'queued' END AS state, claims, CASE WHEN kind <> 'done' AND (kind = 'fail' OR lapsed) AND claims < 5 THEN (CASE WHEN lapsed THEN t + 100 ELSE t END + least(60 * pow(2, greatest(claims - 1, 0)), 3600))::BIGINT END AS due FROM f)"""


@query("ST13_job_states", _JOBS + " SELECT * FROM jobs", True)
def job_states(spark, sf):
    return A.job_states(_jobs(spark, sf), F.lit(900), 100)


@query("T5_next_jobs", _JOBS + " SELECT job, state FROM jobs WHERE state IN ('queued', 'retry') AND coalesce(due, 5000) <= 5000 ORDER BY job % 3 DESC, coalesce(due, 5000), job LIMIT 10", True)
def next_jobs(spark, sf):
    return A.next_job(A.job_states(_jobs(spark, sf), F.lit(900), 100).withColumn("priority", F.col("job") % 3), F.lit(5000).cast("bigint"), 10).select("job", "state")


@query("A11_job_stats", _JOBS + " SELECT job % 4 AS kind, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'retry') AS retry, count(*) FILTER (state = 'dead') AS dead, count(*) FILTER (state = 'done') AS done, min(job) FILTER (state = 'queued') AS oldest FROM jobs GROUP BY 1", True)
def job_stats(spark, sf):
    return A.job_stats(A.job_states(_jobs(spark, sf), F.lit(900), 100).withColumn("kind", F.col("job") % 4).withColumn("at", F.col("job")))


@query("X36_schedules", "SELECT 'c' || c_custkey AS name, CASE WHEN c_nationkey % 3 = 0 THEN 100 ELSE 999 END AS next_due FROM customer")
def schedules(spark, sf):
    c = T_(spark, sf, "customer").withColumn("name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    stored = c.where("c_nationkey % 3 < 2").select("name", F.sha2(F.when(F.col("c_nationkey") % 3 == 0, "x").otherwise("y"), 256).alias("config_sha"), F.lit(100).alias("next_due"))
    return A.schedule(stored, c.select("name", F.lit("x").alias("config")), F.lit(999)).select("name", "next_due")


@query("SY4_cursors", "SELECT c_custkey AS consumer, ['ok', 'epoch_changed', 'high_water_regressed', 'unknown_dataset'][c_custkey % 4 + 1] AS state FROM customer")
def cursors(spark, sf):
    k = F.col("c_custkey") % 4
    c = T_(spark, sf, "customer").select(F.col("c_custkey").alias("consumer"), F.when(k == 3, "other").otherwise("main").alias("dataset"), F.when(k == 1, "e0").otherwise("e1").alias("epoch"), F.when(k == 2, 10**12).otherwise(1).cast("bigint").alias("seq"))
    epochs = T_(spark, sf, "events").agg(F.max("event_id").alias("high_water")).select(F.lit("main").alias("dataset"), F.lit("e1").alias("epoch"), "high_water")
    return A.cursor_state(c, epochs)


@query("SY5_checkpoints", """SELECT k.id, k.id AS high_water, CASE WHEN c.t IS NULL OR k.t - c.t > 300 THEN 'stale' WHEN abs(c.off) > 1000 THEN 'offset' ELSE 'ok' END AS clock FROM (SELECT event_id AS id, epoch(ts)::BIGINT AS t FROM events) k
  LEFT JOIN LATERAL (SELECT t, off FROM (SELECT epoch(ts)::BIGINT AS t, (event_id % 2500) AS off FROM events WHERE event_type = 'error') x WHERE x.t <= k.t ORDER BY x.t DESC, x.off DESC LIMIT 1) c ON true""")
def checkpoints(spark, sf):
    seconds = F.round(P.seconds("ts")).cast("bigint")
    e = T_(spark, sf, "events")
    return A.clock_state(e.select(F.col("event_id").alias("id"), F.col("event_id").alias("high_water"), seconds.alias("at")), e.where("event_type = 'error'").select(seconds.alias("at"), (F.col("event_id") % 2500).alias("offset_ms")))


@query("X26_page_faults", "SELECT user_id AS page, CASE WHEN user_id % 3 = 0 THEN 'missing' WHEN user_id % 3 = 1 THEN 'hash' ELSE 'unlisted' END AS fault FROM (SELECT DISTINCT user_id FROM events)")
def page_faults(spark, sf):
    by = T_(spark, sf, "events").groupBy(F.col("user_id").alias("page")).agg(F.sha2(F.max("event_id").cast("string"), 256).alias("sha256"))
    manifest = by.where("page % 3 < 2").select("page", F.when(F.col("page") % 3 == 1, "0").otherwise(F.col("sha256")).alias("sha256"))
    return A.page_faults(by.where("page % 3 > 0"), manifest)


@query("X27_run_faults", "SELECT c_custkey AS run, CASE c_custkey % 3 WHEN 1 THEN 'partition' ELSE 'duplicates' END AS faults FROM customer WHERE c_custkey % 3 > 0")
def run_faults(spark, sf):
    k = F.col("c_custkey") % 3
    runs = T_(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.lit(10).alias("raw"), F.when(k == 1, 8).otherwise(7).alias("accepted"), F.lit(3).alias("rejected"), F.when(k == 2, 9).otherwise(2).alias("duplicate"))
    return A.run_faults(runs).select("run", F.array_join("faults", ",").alias("faults"))


@query("X35_retries", "SELECT c_custkey AS key, CASE WHEN c_acctbal <= 0 THEN 'new' WHEN c_nationkey % 2 = 0 THEN 'retry' ELSE 'conflict' END AS outcome FROM customer")
def retries(spark, sf):
    c = T_(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    return A.retry_outcome(c.where("c_acctbal > 0").select("key", F.sha2(F.lit("p0"), 256).alias("sha")), c.select("key", F.concat(F.lit("p"), (F.col("c_nationkey") % 2).cast("string")).alias("payload")))


@query("W9_day_list", "SELECT strftime(day, '%Y-%m-%d') AS day, n, coalesce(date_diff('day', lag(day) OVER (ORDER BY day), day) - 1, 0)::INT AS missing FROM (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_id % 97 = 0 GROUP BY 1)")
def day_list(spark, sf):
    return A.day_list(T_(spark, sf, "events").where("event_id % 97 = 0").withColumn("day", F.to_date("ts")), "day").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("A34_growth", "SELECT strftime(day, '%Y-%m-%d') AS day, size, CASE WHEN date_diff('day', lag(day) OVER (ORDER BY day), day) = 1 THEN size - lag(size) OVER (ORDER BY day) END AS growth FROM (SELECT ts::DATE AS day, count(*) AS size FROM events GROUP BY 1)")
def growth(spark, sf):
    return A.growth(T_(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("size")), "day", "size").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("A35_known_window", "SELECT user_id, min(event_id) AS first_seen, max(event_id) AS last_seen, greatest(min(event_id), min(event_id) FILTER (event_type = 'purchase')) AS known_from FROM events GROUP BY user_id")
def known_window(spark, sf):
    e = T_(spark, sf, "events").withColumn("accepted", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return A.known_window(e, "user_id", "event_id", "accepted")


@query("A7_heat_decay", "SELECT o_orderkey, round(o_totalprice * pow(0.5, greatest((o_orderkey % 72)::DOUBLE, 0) / 18.0), 6) AS heat FROM orders")
def heat_decay(spark, sf):
    return T_(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * O.decay((F.col("o_orderkey") % 72).cast("double")), 6).alias("heat"))


# Samples, reviews, gates


@query("U10_greedy_split")
def greedy_split(spark, sf):
    """Components (a user's events) to splits of 60, 20 and 20 percent, whole components only."""
    groups = T_(spark, sf, "events").groupBy(F.col("user_id").alias("group")).agg(F.count("*").alias("n"))
    return V.greedy_split(groups, {"train": 0.6, "dev": 0.2, "test": 0.2})


@query("U11_blind_holdout", """WITH g AS (SELECT user_id AS grp, count(*) AS n, max((event_id > 900)::INT) AS recent, max((event_type = 'signup')::INT) AS held, sha256('s:' || user_id) AS draw FROM events GROUP BY user_id),
  t AS (SELECT sum(n) * 0.9 - sum(CASE WHEN recent + held > 0 THEN n ELSE 0 END) AS want FROM g), f AS (SELECT *, coalesce(sum(n) OVER (ORDER BY draw, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM g WHERE recent + held = 0)
  SELECT grp AS "group", n, 'test' AS split FROM g WHERE recent + held > 0 UNION ALL SELECT grp, n, CASE WHEN upto < want THEN 'test' ELSE 'train' END FROM f, t""")
def blind_holdout(spark, sf):
    cases = T_(spark, sf, "events").select(F.col("user_id").alias("group"), F.col("event_type").alias("source"), "event_id")
    return V.blind_holdout(cases, F.col("event_id") > 900, "signup", 0.9, "s")


@query("X9_sample_batch", "SELECT doc_id, source, rank::INT AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('seed:' || doc_id), doc_id) AS rank FROM documents WHERE doc_id <= 150) WHERE rank <= 7")
def sample_batch(spark, sf):
    return V.sample_batch(T_(spark, sf, "documents"), "source", "doc_id", "seed", 7, 150)[1]


@query("A12_effective_metrics", "SELECT o_orderpriority AS g, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus <> 'P') AS decided, count(*) FILTER (o_orderstatus <> 'P') * 10000 // count(*) AS decided_bps, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 10000 ELSE count(*) FILTER (o_orderstatus = 'F') * 10000 // count(*) FILTER (o_orderstatus <> 'P') END AS accepted_bps FROM orders GROUP BY 1")
def effective_metrics(spark, sf):
    a = T_(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.lit("candidate").alias("status"))
    reviews = T_(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("decision"), F.lit(1).alias("sequence"))
    return V.status_metrics(E.effective(a, reviews, "o_orderkey"), "g")


_ADMISSION = """, m AS (SELECT user_id, count(*) AS evidence, count(*) FILTER (event_type <> 'view') AS direct, count(DISTINCT event_id % 50) AS documents, count(DISTINCT event_id % 7) AS publishers, count(DISTINCT CASE WHEN (event_id % 7) % 2 = 0 THEN event_id % 7 END) AS verified FROM events WHERE value > 60 GROUP BY user_id),
  c AS (SELECT c_custkey AS event_id, c_name AS title, CASE c_nationkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'reported' ELSE 'candidate' END AS status, coalesce(evidence, 0) AS evidence, coalesce(direct, 0) AS direct, coalesce(documents, 0) AS documents, coalesce(publishers, 0) AS publishers, coalesce(verified, 0) AS verified FROM customer LEFT JOIN m ON user_id = c_custkey)"""


def _admissions(spark, sf):
    k = F.col("c_nationkey") % 3
    events = T_(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("title"), F.when(k == 0, "confirmed").when(k == 1, "reported").otherwise("candidate").alias("status"))
    evidence = T_(spark, sf, "events").where("value > 60").select(F.col("user_id").alias("event_id"), (F.col("event_id") % 50).alias("document"), (F.col("event_id") % 7).alias("publisher"), (F.col("event_type") != "view").alias("direct"))
    publishers = spark.range(7).select(F.col("id").alias("publisher"), (F.col("id") % 2 == 0).alias("verified"))
    return V.admission_metrics(events, evidence, publishers)


@query("A14_admission_metrics", _ADMISSION + " SELECT event_id, evidence, direct, documents, publishers, verified FROM c", True)
def admission_metrics(spark, sf):
    return _admissions(spark, sf).select("event_id", "evidence", "direct", "documents", "publishers", "verified")


@query("D13_admission", _ADMISSION + " SELECT event_id, CASE WHEN status = 'candidate' THEN 'status' WHEN len(trim(title)) < 8 THEN 'title' WHEN evidence < 1 THEN 'evidence' WHEN direct < 1 THEN 'direct' WHEN documents < 2 THEN 'documents' WHEN publishers < 2 THEN 'publishers' WHEN verified < 1 THEN 'verified' END AS failure FROM c", True)
def admission(spark, sf):
    return V.admission(_admissions(spark, sf))


@query("A15_topic_build", """, l AS (SELECT event_type AS topic, event_id % 300 AS document, arg_max(CASE WHEN value > 30 THEN 'accepted' ELSE 'rejected' END, event_id) AS status FROM events GROUP BY ALL)
  SELECT topic, count(*) AS documents, min(document) AS first_at, max(document) AS last_at FROM l WHERE status = 'accepted' GROUP BY topic""", True)
def topic_build(spark, sf):
    a = T_(spark, sf, "events").select(F.col("event_type").alias("topic"), (F.col("event_id") % 300).alias("document"), F.col("event_id").alias("sequence"), F.when(F.col("value") > 30, "accepted").otherwise("rejected").alias("status"))
    documents = a.select("document").distinct().withColumn("published", F.col("document"))
    return V.topic_build(a, documents).select("topic", "documents", "first_at", "last_at")


@query("D32_published_topics", "SELECT event_type AS topic, sha256(string_agg(p || h, '' ORDER BY p)) AS manifest FROM (SELECT event_type, substr(s, 1, 2) AS p, sha256(string_agg(s, '' ORDER BY s)) AS h FROM (SELECT DISTINCT event_type, sha256((event_id % 300)::VARCHAR) AS s FROM events) GROUP BY 1, 2) GROUP BY event_type")
def published_topics(spark, sf):
    a = T_(spark, sf, "events").select(F.col("event_type").alias("topic"), (F.col("event_id") % 300).alias("document"), F.col("event_id").alias("sequence"), F.lit("accepted").alias("status"))
    return V.topic_build(a, a.select("document").distinct().withColumn("published", F.col("document"))).select("topic", "manifest")


@query("A18_summary", "WITH d AS (SELECT quality AS a, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE toxic END AS p FROM labels), c AS (SELECT * FROM d WHERE p <> -1), l AS (SELECT a AS x FROM c UNION SELECT p FROM c), f AS (SELECT x, (SELECT count(*) FROM c WHERE a = x AND p = x) AS r, (SELECT count(*) FROM c WHERE a = x) AS s, (SELECT count(*) FROM c WHERE p = x) AS q FROM l) SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM c)::DOUBLE / (SELECT count(*) FROM d) AS coverage, (SELECT count(*) FROM c WHERE a = p)::DOUBLE / (SELECT count(*) FROM c) AS accuracy, avg(CASE WHEN s = 0 OR q = 0 OR r = 0 THEN 0.0 ELSE 2.0 * r / (s + q) END) AS macro_f1 FROM f")
def summary(spark, sf):
    d = T_(spark, sf, "labels").select(F.col("quality").cast("string").alias("a"), F.when(F.col("doc_id") % 5 == 0, "-1").otherwise(F.col("toxic").cast("string")).alias("p"))
    return V.summary(d, "a", "p", "-1")


@query("A21_kappa_interval")
def kappa_interval(spark, sf):
    """The bootstrap interval of kappa of two labels."""
    return V.agreement_interval(T_(spark, sf, "labels"), "quality", "toxic")


@query("A22_exact_components", "WITH b AS (SELECT user_id, count(DISTINCT event_type) AS r, count(DISTINCT event_id % 2) AS x, count(DISTINCT floor(value / 100)) AS y FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1) SELECT 'x' AS component, count(*) AS n, count(*) FILTER (x = 1) AS same, count(*) FILTER (x = 1) * 10000 // count(*) AS bps FROM b UNION ALL SELECT 'y', count(*), count(*) FILTER (y = 1), count(*) FILTER (y = 1) * 10000 // count(*) FROM b")
def exact_components(spark, sf):
    reviews = T_(spark, sf, "events").select("user_id", "event_type", (F.col("event_id") % 2).alias("x"), F.floor(F.col("value") / 100).alias("y"))
    return V.exact_components(reviews, "user_id", "event_type", ["x", "y"])


@query("A24_temperature")
def temperature(spark, sf):
    """The temperature of made-up logits of the labels, from their counts by logit."""
    logits = T_(spark, sf, "labels").select((F.col("doc_id") % 9 - 4).cast("double").alias("logit"), F.col("quality").alias("right"))
    buckets = [(r["logit"], r["right"], r["n"]) for r in logits.groupBy("logit").agg(F.sum("right").alias("right"), F.count("*").alias("n")).orderBy("logit").collect()]  # a row for each distinct logit
    return spark.createDataFrame([M.temperature(buckets)], "temperature double, loss double")


@query("A26_compare_models", "WITH m AS (SELECT source, avg((quality = toxic)::INT) AS base, avg((quality = doc_id % 2)::INT) AS new FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source) SELECT source, 'accuracy' AS metric, base, new, new - base AS delta, coalesce(new - base < -0.02, true) AS regression FROM m")
def compare_models(spark, sf):
    both = T_(spark, sf, "labels").join(T_(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    named = both.where("source is not null")
    of = lambda c: named.groupBy("source").agg(F.avg((F.col("quality") == c).cast("int")).alias("accuracy"))
    return V.compare_models(of(F.col("toxic")), of(F.col("doc_id") % 2), "source", ["accuracy"])


@query("X5_approvals", "SELECT c_custkey AS subject, ['unreviewed', 'rejected', 'stale', 'below', 'approved'][c_custkey % 5 + 1] AS state FROM customer")
def approvals(spark, sf):
    k = F.col("c_custkey") % 5
    current = T_(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.lit("m").alias("metrics_sha"), F.when(k == 3, 10).otherwise(9000).alias("decided_bps"))
    reviews = T_(spark, sf, "customer").where(k > 0).select(F.col("c_custkey").alias("subject"), F.explode(F.array(F.lit(1), F.lit(2))).alias("sequence"), k.alias("k"))
    reviews = reviews.select("subject", "sequence", F.when((F.col("sequence") == 2) & (F.col("k") > 1), "approve").otherwise("reject").alias("decision"), F.when(F.col("k") == 2, "old").otherwise("m").alias("metrics_sha"))
    return V.approvals(reviews, current, {"decided_bps": 9000})


@query("X6_tampered_reviews", "SELECT c_custkey AS subject, 2 AS sequence FROM customer WHERE c_custkey % 3 = 0")
def tampered(spark, sf):
    c = T_(spark, sf, "customer").select(F.col("c_custkey").alias("subject"))
    first = c.withColumns({"sequence": F.lit(1), "decision": F.lit("approve")}).withColumn("sha", F.sha2(F.col("decision"), 256))
    second = c.withColumns({"sequence": F.lit(2), "decision": F.lit("reject")}).withColumn("sha", F.sha2(F.concat(F.sha2(F.lit("approve"), 256), F.when(F.col("subject") % 3 == 0, "forged").otherwise(F.col("decision"))), 256))
    return V.tampered(first.union(second), ["decision"]).select("subject", "sequence")


@query("X8_sample_gate", "SELECT o_orderpriority AS subject, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') * 10000 // count(*) < 9000 THEN 'decided' ELSE '' END AS failed FROM orders GROUP BY 1")
def sample_gate(spark, sf):
    by = T_(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("subject")).agg(M.bps(F.count_if(F.col("o_orderstatus") != "P"), F.count("*")).alias("decided"))
    return M.gate(by, {"decided": F.col("decided") >= 9000}).select("subject", "failed")


@query("X10_intake", "SELECT event_id AS case_id, CASE event_id % 5 WHEN 1 THEN 'unknown_case' WHEN 2 THEN 'content' WHEN 3 THEN 'label' ELSE 'reviewer' END AS faults FROM events WHERE event_id % 5 > 0")
def intake(spark, sf):
    k = F.col("event_id") % 5
    rows = T_(spark, sf, "events").select(F.col("event_id").alias("case_id"), F.when(k == 4, " ").otherwise("ann").alias("reviewer"), F.when(k == 3, "maybe").otherwise("yes").alias("label"), F.sha2(F.when(k == 2, "other").otherwise("text"), 256).alias("content_sha256"))
    cases = T_(spark, sf, "events").where(k != 1).select(F.col("event_id").alias("case_id"), F.lit("text").alias("content"))
    return V.intake_faults(rows, cases, ["yes", "no"]).select("case_id", "faults")


@query("X11_adjudication", "SELECT event_id, ['', 'two_reviews', 'third_person', 'after_reviews'][event_id % 4 + 1] AS faults FROM events")
def adjudication(spark, sf):
    k = F.col("event_id") % 4
    d = T_(spark, sf, "events").select("event_id", F.when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("reviewers"), F.array(F.lit(1), F.when(k == 3, 9).otherwise(2)).alias("times"), F.when(k == 2, "b").otherwise("c").alias("decider"), F.lit(5).alias("decided_at"))
    return E.adjudication_faults(d).select("event_id", "faults")


@query("X12_verified_holdout", "SELECT event_id FROM events WHERE (ts >= TIMESTAMP '2024-01-25' OR event_type = 'signup') AND event_id % 3 <> 0")
def verified_holdout(spark, sf):
    cases = T_(spark, sf, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 == 0, "test").otherwise("train").alias("split"))
    return V.verified_holdout(cases, lit_ts("2024-01-25"), "signup").select("event_id")


@query("X16_probabilities", "SELECT event_id, ['range,sum', 'sum', 'argmax'][event_id % 4] AS faults FROM events WHERE event_id % 4 > 0")
def probabilities(spark, sf):
    k = F.col("event_id") % 4
    p = lambda *x: F.array(*[F.lit(v) for v in x])
    return V.probability_faults(T_(spark, sf, "events").select("event_id", F.when(k == 0, p(0.7, 0.2, 0.1)).when(k == 1, p(1.2, 0.1, 0.2)).when(k == 2, p(0.5, 0.3, 0.1)).otherwise(p(0.4, 0.4, 0.2)).alias("p")), "event_id", "p")


@query("X19_silver_targets", "SELECT doc_id AS case_id FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def silver_targets(spark, sf):
    cases = T_(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    return V.silver_targets(cases, T_(spark, sf, "labels").select(F.col("doc_id").alias("case_id"))).select("case_id")


@query("X20_legacy_run", "SELECT item_id, CASE tmt WHEN 1 THEN 'relevant' WHEN 0 THEN 'irrelevant' ELSE 'abstain' END AS label FROM items", True)
def legacy_run(spark, sf):
    return R.items(spark, sf).select("item_id", F.when(F.col("tmt") == 1, "relevant").when(F.col("tmt") == 0, "irrelevant").otherwise("abstain").alias("label"))


@query("X22_backfill", "SELECT item_id, official OR event_type = 'purchase' AS keep FROM items WHERE tmt IS NULL AND score IS NOT NULL", True)
def backfill(spark, sf):
    return R.items(spark, sf).where("tmt is null and score is not null").select("item_id", (F.col("official") | (F.col("event_type") == "purchase")).alias("keep"))


@query("X23_import_audit", "SELECT 'lost' AS rule, count(*) FILTER (c_acctbal < 0) AS n FROM customer UNION ALL SELECT 'made_up', 0 UNION ALL SELECT 'v', count(*) FILTER (c_acctbal >= 0 AND c_nationkey % 3 <> c_nationkey % 5) FROM customer")
def import_audit(spark, sf):
    c = T_(spark, sf, "customer")
    side = lambda df, m: df.select("c_custkey", (F.col("c_nationkey") % m).alias("v"))
    return V.import_audit(side(c, 3), side(c.where("c_acctbal >= 0"), 5), "c_custkey", ["v"])


@query("X37_revisions", "SELECT c_custkey AS revision_id, ['unsorted', 'repeated', 'evidence'][c_custkey % 4] AS faults FROM customer WHERE c_custkey % 4 > 0")
def revisions(spark, sf):
    k = F.col("c_custkey") % 4
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    r = T_(spark, sf, "customer").select(F.col("c_custkey").alias("revision_id"), F.when(k == 1, ids("b", "a")).when(k == 2, ids("a", "a")).otherwise(ids("a", "b")).alias("entity_ids"), ids("f1", "f2").alias("fact_ids"))
    evidence = T_(spark, sf, "customer").select(F.col("c_custkey").alias("revision_id"), F.explode(F.when(k == 3, ids("f1")).otherwise(ids("f1", "f2"))).alias("fact_id"))
    return V.revision_faults(r, evidence)


@query("X39_evidence_ids", "SELECT event_id, unnest(['e' || event_id, 'f' || event_id % 9, 'g']) AS evidence_id FROM events")
def evidence_ids(spark, sf):
    i = F.col("event_id")
    payload = F.concat(F.lit('{"a": [{"evidence_id": "e'), i.cast("string"), F.lit('"}], "b": {"evidence_ids": ["f'), (i % 9).cast("string"), F.lit('", "g", "g"]}}'))
    return V.evidence_ids(T_(spark, sf, "events").select("event_id", payload.alias("p")), "event_id", "p")


@query("D11_projected_events", f"""WITH RECURSIVE {R.oracle_items()}, {R.oracle_stories()}, walk AS (SELECT story_id AS id, story_id AS here, 0 AS depth FROM stories UNION ALL SELECT w.id, s.redirect_to, depth + 1 FROM walk w JOIN stories s ON s.story_id = w.here WHERE s.redirect_to IS NOT NULL AND depth < 70),
  ends AS (SELECT id, arg_max(here, depth) AS here, max(depth) AS depth FROM walk GROUP BY id) SELECT e.here AS event, count(DISTINCT item_id % 40) AS documents, array_to_string(list_sort(list_distinct(list('E' || company))), ',') AS entities, strftime(min(published_at), {TS_SQL}) AS first_at FROM items i JOIN ends e ON e.id = i.story_id WHERE depth < 70 AND e.here IN (SELECT story_id FROM stories) GROUP BY 1""")
def projected_events(spark, sf):
    members = R.items(spark, sf).where("story_id is not null").select("story_id", (F.col("item_id") % 40).alias("document"), "company", F.col("published_at").alias("published"))
    names = members.select("company").distinct().withColumn("entity", F.concat(F.lit("E"), "company"))
    out = V.projected_events(R.stories(spark, sf).select("story_id", "redirect_to"), members, names)
    return out.select("event", "documents", F.array_join("entities", ",").alias("entities"), at("first_at").alias("first_at"))


@query("D4_news_api", f"""WITH {R.oracle_items()}, {NEWS}, r AS (SELECT i.item_id, i.published_at, i.company, CASE WHEN i.item_id % 3 = 0 AND score >= 0 THEN score END AS s, CASE WHEN i.official THEN 'official' WHEN i.story_id IS NULL OR i.item_id = min(i.item_id) OVER (PARTITION BY i.story_id) THEN 'report' ELSE 'repost' END AS independence, title
   FROM items i JOIN news n USING (item_id) WHERE coalesce(tmt, 1) <> 0 AND published_at > TIMESTAMP '2024-01-01' AND published_at <= TIMESTAMP '2024-01-20')
  SELECT item_id, strftime(published_at, {TS_SQL}) AS published_at, s AS score, independence FROM r WHERE company IN ('c1', 'c2', 'c3') AND regexp_matches(title, 'HBM4|Data center|Smuggling|台积电') AND (s IS NULL OR s >= 50) ORDER BY r.published_at DESC, item_id DESC LIMIT 40""")
def news_api(spark, sf):
    titled = news(spark, sf).select("item_id", T.themes(F.col("title")).alias("themes"))
    items = R.items(spark, sf).join(titled, "item_id").withColumn("fetched_at", F.col("published_at")).withColumn("judged_at", F.when(F.col("item_id") % 3 == 0, F.col("published_at")))
    out = V.news_api(items, ["c1", "c2", "c3"], None, "industry", lit_ts("2024-01-01"), lit_ts("2024-01-20"), None, 40)
    return out.select("item_id", at("published_at").alias("published_at"), "score", "independence")


@query("D18_ledger", "SELECT event_id, spent, fits, CASE WHEN event_type = 'error' THEN 'failed' WHEN NOT fits THEN 'refused' ELSE 'published' END AS state FROM (SELECT event_id, event_type, spent, spent + c <= 500 AS fits FROM (SELECT event_id, event_type, floor(value)::BIGINT AS c, coalesce(sum(greatest(floor(value)::BIGINT, 0)) OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM events))")
def ledger(spark, sf):
    a = T_(spark, sf, "events").select("event_id", "event_type", "user_id", F.to_date("ts").alias("day"), F.floor("value").cast("bigint").alias("cost"))
    out = S.budget(a, ["user_id", "day"], "event_id", "cost", 500)
    return out.select("event_id", "spent", "fits", F.when(F.col("event_type") == "error", "failed").when(~F.col("fits"), "refused").otherwise("published").alias("state"))


@query("D14_release_floors", "SELECT l_returnflag AS subject, count(*) * 10000 // count(*) AS cov, count(*) FILTER (l_linestatus = 'F') * 10000 // count(*) AS fin, CASE WHEN count(*) FILTER (l_linestatus = 'F') * 10000 // count(*) < 9000 THEN 'fin' ELSE '' END AS failed FROM lineitem GROUP BY 1")
def release_floors(spark, sf):
    by = T_(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("subject")).agg(M.bps(F.count("*"), F.count("*")).alias("cov"), M.bps(F.count_if(F.col("l_linestatus") == "F"), F.count("*")).alias("fin"))
    return M.gate(by, {"cov": F.col("cov") >= 10_000, "fin": F.col("fin") >= 9000}).select("subject", "cov", "fin", "failed")


@query("D22_judging", "SELECT event_id AS item_id, CASE WHEN j.s IS NOT NULL THEN 'reused' WHEN event_id % 8 = 0 THEN 'rule' ELSE 'pending' END AS how, CASE WHEN j.s IS NOT NULL THEN greatest(0, least(100, j.s)) WHEN event_id % 8 = 0 THEN 25 END AS judged_score FROM events e LEFT JOIN (SELECT user_id, event_type, arg_min(floor(value * 2)::INT, event_id) AS s FROM events WHERE event_id % 10 = 3 GROUP BY ALL) j ON j.user_id = e.user_id AND j.event_type = e.event_type")
def judging(spark, sf):
    e = T_(spark, sf, "events").withColumnRenamed("event_id", "item_id")
    judged = e.where("item_id % 10 = 3").withColumn("score", F.floor(F.col("value") * 2).cast("int"))
    return V.reuse_or_judge(e.withColumn("routine", F.col("item_id") % 8 == 0), judged, ["user_id", "event_type"]).select("item_id", "how", "judged_score")


@query("D26_review_queue", "SELECT user_id, event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') ORDER BY event_id LIMIT 30")
def review_queue(spark, sf):
    e = T_(spark, sf, "events")
    return e.where("event_type = 'error'").join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_anti").orderBy("event_id").limit(30).select("user_id", "event_id")


@query("D27_review_export", "SELECT o_orderpriority AS topic, count(*) AS n, sha256(string_agg(s, '' ORDER BY s)) AS digest FROM (SELECT o_orderpriority, sha256('{\"decision\":\"' || o_orderstatus || '\",\"document\":' || o_orderkey || '}') AS s FROM orders) GROUP BY 1")
def review_export(spark, sf):
    row = F.sha2(F.to_json(F.struct(F.col("o_orderstatus").alias("decision"), F.col("o_orderkey").alias("document"))), 256)
    return T_(spark, sf, "orders").select(F.col("o_orderpriority").alias("topic"), row.alias("s")).groupBy("topic").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("s")), ""), 256).alias("digest"))


@query("F26_redacted", "SELECT event_id, 'see http://x/y?a=1&token=[redacted] key=[redacted] end' AS t FROM events")
def redacted(spark, sf):
    t = F.concat(F.lit("see http://x/y?a=1&token="), F.sha2(F.col("event_id").cast("string"), 256), F.lit(" key=abc"), F.col("event_id").cast("string"), F.lit(" end"))
    return T_(spark, sf, "events").select("event_id", X.redacted(t).alias("t"))


@query("U6_array_sets", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) FILTER (value > 50))), ',') AS high, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: NOT list_contains(coalesce(list_distinct(list(event_type) FILTER (value > 50)), []), x))), ',') AS lost FROM events GROUP BY user_id")
def array_sets(spark, sf):
    by = T_(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("b"))
    return by.select("user_id", F.array_join(F.array_sort("b"), ",").alias("high"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("lost"))


# Contracts, manifests, proofs


def _cases(spark, sf, cases, fields, choices=None):
    payload = F.element_at(F.array(*[F.lit(x) for x in cases]), (F.col("event_id") % len(cases) + 1).cast("int"))
    return T_(spark, sf, "events").select("event_id", F.array_join(K.contract_faults(payload, fields, choices), ",").alias("faults"))


@query("D29_tone_contracts", "SELECT event_id, ['', 'choice:speaker', 'missing:quote', 'type:confidence'][event_id % 4 + 1] AS faults FROM events")
def tone_contracts(spark, sf):
    cases = ('{"speaker": "company", "quote": "we grew", "confidence": 80}', '{"speaker": "nobody", "quote": "x", "confidence": 1}', '{"speaker": "analyst", "confidence": 5}', '{"speaker": "analyst", "quote": "q", "confidence": "high"}')
    return _cases(spark, sf, cases, {"speaker": "string", "quote": "string", "confidence": "int"}, {"speaker": ["company", "analyst", "media"]})


@query("X14_impact_contracts", "SELECT event_id, ['', 'choice:horizon', 'type:private'][event_id % 3 + 1] AS faults FROM events")
def impact_contracts(spark, sf):
    cases = ('{"horizon": "days", "role": "evidence", "private": false}', '{"horizon": "aeons", "role": "fact", "private": true}', '{"horizon": "weeks", "role": "fact", "private": 1}')
    return _cases(spark, sf, cases, {"horizon": "string", "role": "string", "private": "bool"}, {"horizon": ["days", "weeks", "quarters"], "role": ["evidence", "fact"]})


@query("SC13_manifest", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'missing:text,unknown' END AS faults FROM events")
def manifest_shape(spark, sf):
    """Lines of a manifest against its exact fields, over the events' own payloads put into one."""
    k = F.get_json_object("props", "$.k")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"id": '), k, F.lit(', "text": "t"}'))).otherwise(F.concat(F.lit('{"id": '), k, F.lit(', "note": "t"}')))
    return T_(spark, sf, "events").select("event_id", F.array_join(K.contract_faults(line, {"id": "int", "text": "string"}), ",").alias("faults"))


@query("D21_manifest_verify", "SELECT user_id, user_id % 4 <> 0 AS sound FROM (SELECT DISTINCT user_id FROM events)")
def manifest_verify(spark, sf):
    """Frozen report inputs, of which some lost a member, against the hash of their ordered members."""
    e = T_(spark, sf, "events")
    frozen = e.groupBy("user_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ","), 256).alias("sha"))
    last = e.groupBy(F.col("user_id").alias("u")).agg(F.max("event_id").alias("gone"))
    now = e.join(last, F.col("user_id") == F.col("u")).where((F.col("user_id") % 4 != 0) | (F.col("event_id") != F.col("gone")))
    members = now.groupBy("user_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ","), 256).alias("now"))
    return frozen.join(members, "user_id", "left").select("user_id", F.col("sha").eqNullSafe(F.col("now")).alias("sound"))


@query("X7_sample_proof", "SELECT source AS subject, CASE WHEN max(doc_id) % 2 = 0 THEN 'current' ELSE 'stale' END AS state FROM documents WHERE source IS NOT NULL GROUP BY source")
def sample_proof(spark, sf):
    """Whether a sample was drawn at what is now the high water of its assignments."""
    now = T_(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("subject")).agg(F.max("doc_id").alias("high"))
    drawn = now.select("subject", F.when(F.col("high") % 2 == 0, F.col("high")).otherwise(F.col("high") - 1).alias("drawn_at"))
    return now.join(drawn, "subject").select("subject", F.when(F.col("high") == F.col("drawn_at"), "current").otherwise("stale").alias("state"))


@query("X17_provenance", "SELECT event_id, ['', 'dataset', 'split', 'abstain'][event_id % 4 + 1] AS failed FROM events")
def provenance(spark, sf):
    k = F.col("event_id") % 4
    runs = T_(spark, sf, "events").select("event_id", F.when(k == 1, "old").otherwise("d1").alias("dataset_sha"), F.when(k == 2, "train").otherwise("test").alias("split"), F.when(k == 3, "").otherwise("abstain").alias("abstain"))
    return M.gate(runs, {"dataset": F.col("dataset_sha") == "d1", "split": F.col("split") == "test", "abstain": F.col("abstain") != ""}).select("event_id", "failed")


@query("X21_backfill_progress", "SELECT user_id % 8 AS batch, count(*) AS total, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS remaining FROM events GROUP BY 1")
def backfill_progress(spark, sf):
    """Rows mapped and still to map for each batch of a backfill."""
    e = T_(spark, sf, "events").withColumn("batch", F.col("user_id") % 8)
    mapped = e.where("event_type <> 'error'").select("event_id", F.lit(1).alias("mapped"))
    return e.join(mapped, "event_id", "left").groupBy("batch").agg(F.count("*").alias("total"), F.count("mapped").alias("done"), F.count_if(F.col("mapped").isNull()).alias("remaining"))


@query("X38_review_preview", "SELECT user_id, max(event_id) AS sequence, arg_max(event_type, event_id) AS decision, count(*) AS reviews FROM events GROUP BY user_id")
def review_preview(spark, sf):
    e = T_(spark, sf, "events").select("user_id", F.col("event_id").alias("sequence"), F.col("event_type").alias("decision"))
    last = P.latest(e, ["user_id"], ["sequence"])
    return last.join(e.groupBy("user_id").agg(F.count("*").alias("reviews")), "user_id").select("user_id", "sequence", "decision", "reviews")


@query("D20_clusters", "SELECT story_id, count(DISTINCT publisher) AS publishers, count(*) AS items FROM items WHERE coalesce(tmt, 1) <> 0 AND story_id IS NOT NULL AND published_at >= TIMESTAMP '2024-01-02' AND published_at < TIMESTAMP '2024-01-03' GROUP BY story_id HAVING count(DISTINCT publisher) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 12", True)
def clusters(spark, sf):
    day = O.visible(R.items(spark, sf)).where((F.col("published_at") >= lit_ts("2024-01-02")) & (F.col("published_at") < lit_ts("2024-01-03")) & F.col("story_id").isNotNull())
    by = day.groupBy("story_id").agg(F.count_distinct("publisher").alias("publishers"), F.count("*").alias("items")).where("publishers >= 2")
    return by.orderBy(F.col("publishers").desc(), F.col("items").desc(), "story_id").limit(12)


@query("SK4_json_lines", "SELECT o_orderstatus AS status, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY 1")
def json_lines(spark, sf):
    """Rows written as JSON lines and read back by their schema."""
    import uuid

    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/lines-" + uuid.uuid4().hex
    T_(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.json(folder)
    back = R.read_any(spark, folder, "json", "o_orderkey long, o_custkey long, o_orderstatus string")
    return back.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))
