"""Registered queries on titles, links, topics, themes and stories, over headlines and over the pages' own titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .functions import times as C
from .functions import titles as T
from .operators import linking as L
from .operators import stories as Y
from .queries import ORACLES, T_, TS, TS_SQL, query
from .sources import tables as R

#: Headlines that items bear in turn, so that every rule on titles has something to find.
HEADLINES = [
    "Why is Arm stock sliding today?",
    "What is going on with Oracle stock Tuesday?",
    "Nvidia launches H200 GPU for AI servers",
    "英伟达发布新一代人工智能芯片",
    "Apple Inc reports Q3 2025 earnings",
    "Apple orchard opens for apple picking season",
    "Wet AMD treatment shows promise in retina trial",
    "AMD releases MI350 accelerator",
    "Meta-analysis finds meta effects of diet",
    "Meta announced Llama 4.1 model",
    "财联社10月19日电，台积电扩产先进封装产能",
    "甲骨文股价今日下跌原因分析",
    "【美联储宣布降息25个基点】市场反应强烈",
    "Federal Reserve signals rate cut as inflation eases",
    "Company denied merger talks with rival",
    "2025年第三季度出货量增长12.5%",
    "Quarter 2 results for 2024 beat estimates",
    "HBM4 memory prices rise on chip shortage",
    "Smuggling of chips leads to new export controls",
    "玻利维亚放松黄金出口管制",
    "Data center power demand strains power grid",
    "核心F核心 技术突破",
    "股价异>异动 说明",
    "GPT-4.5 released with lower prices",
    "ON Semiconductor stock price up 4.2%",
    "On the road again with family",
    "哈哈哈哈哈 真好",
    "Tariffs and sanctions weigh on trade deal",
    "Unbalanced (bracket in a title",
    "S&P 500 and Dow Jones end higher than broader market",
]
_TITLE = "CASE event_id % {n} ".format(n=len(HEADLINES)) + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(HEADLINES)) + " END"
_SOURCE = "CASE event_id % 5 WHEN 0 THEN 'sina' WHEN 1 THEN 'rss' WHEN 2 THEN 'sec' WHEN 3 THEN 'hkex' ELSE 'cls' END"
NEWS = f"news AS (SELECT event_id AS item_id, user_id, {_TITLE} AS title, {_SOURCE} AS source_type, event_type, value, ts FROM events)"
#: Pages as articles, with the facts that guards ask for.
ARTICLES = {
    "id": "page_id",
    "title": r"regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "published": "timestamp '2024-03-01 00:00:00' + page_id * 37 % 9000 * interval '1' minute",
    "source_type": "CASE page_id % 4 WHEN 0 THEN 'sina' ELSE 'rss' END",
    "channel": "CASE page_id % 3 WHEN 0 THEN 'ai' ELSE 'stock' END",
    "event_type": "CASE page_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'launch' ELSE NULL END",
    "official": "page_id % 11 = 0",
    "form": "CASE WHEN page_id % 22 = 0 THEN '8-K' END",
    "url": "url",
}


def news(spark, sf):
    return T_(spark, sf, "events").selectExpr("event_id AS item_id", "user_id", f"{_TITLE} AS title", f"{_SOURCE} AS source_type", "event_type", "value", "ts")


def articles(spark, sf):
    company = F.when(F.col("page_id") % 4 == 3, F.array()).otherwise(F.array(F.concat(F.lit("c"), (F.col("page_id") % 2).cast("string"))))
    return T_(spark, sf, "pages").selectExpr(*[f"{e} AS {n}" for n, e in ARTICLES.items()], "page_id").withColumn("companies", company.cast("array<string>")).drop("page_id")


def on_news(name, sql):
    return query(name, f"WITH {NEWS} {sql}")


def re2(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def word_sql(words: str, edge: str = "a-z0-9-") -> str:
    return re2(rf"(^|[^{edge}])({T.any_of(words.split('|'))})($|[^{edge}])")


# Titles


_SAME_STORY = "replace(replace(replace(lower(title), '人工智能', 'ai'), '发布', '推出'), '上线', '推出')"


@on_news("F4_story_title", rf"SELECT item_id, regexp_replace(regexp_replace({_SAME_STORY}, '\b(launches|launched|releases|released|introduces|introduced)\b', 'launch', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM news")
def story_title(spark, sf):
    return news(spark, sf).select("item_id", T.story_title(F.col("title")).alias("t"))


@on_news("F5_event_title", r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(list_reduce([lower(title), '人工智能|ai', '发布|announce', '宣布|announce', '推出|launch', '上线|launch', '否认|deny', '季度业绩|quarter results', '财报|earnings'],
  lambda x, y: replace(x, split_part(y, '|', 1), split_part(y, '|', 2))), '\b(announces?|announced|releases?|released|launches?|launched|introduces?|introduced)\b', ' announce ', 'g'), '\b(denies|denied|rejects|rejected)\b', ' deny ', 'g'), '[^\p{L}\p{N}_]+', '', 'g') AS t FROM news""")
def event_title(spark, sf):
    return news(spark, sf).select("item_id", T.event_title(F.col("title")).alias("t"))


@on_news("F6_headline", r"""SELECT item_id, regexp_replace(regexp_replace(replace(replace(replace(lower(CASE WHEN source_type = 'sina' AND regexp_matches(u, '^【[^】]+】') THEN regexp_extract(u, '^【([^】]+)】', 1) ELSE u END), '人工智能', 'ai'), '发布', '推出'), '上线', '推出'),
  '\b(launches|launched|releases|released|introduces|introduced)\b', 'launch', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS t FROM (SELECT *, nfc_normalize(replace(replace(trim(regexp_replace(title, '^财联社\d{1,2}月\d{1,2}日电[，,]\s*', '')), '（', '('), '）', ')')) AS u FROM news)""")
def headline(spark, sf):
    return news(spark, sf).select("item_id", T.headline(X.nfkc()("title"), F.col("source_type")).alias("t"))


@on_news("F10_quarter", r"""SELECT item_id, CASE WHEN regexp_matches(t, '\b(q|quarter\s*)[1-4]\D{0,12}20\d{2}\b') THEN regexp_extract(t, '\b(?:q|quarter\s*)([1-4])\D{0,12}(20\d{2})\b', 2) || '-Q' || regexp_extract(t, '\b(?:q|quarter\s*)([1-4])\D{0,12}(20\d{2})\b', 1)
  WHEN regexp_matches(t, '(20\d{2})\s*年?\s*第?[一二三四1234]季度') THEN regexp_extract(t, '(20\d{2})\s*年?\s*第?([一二三四1234])季度', 1) || '-Q' || translate(regexp_extract(t, '(20\d{2})\s*年?\s*第?([一二三四1234])季度', 2), '一二三四', '1234') END AS q FROM (SELECT *, lower(title) AS t FROM news)""")
def quarter(spark, sf):
    return news(spark, sf).select("item_id", T.quarter(F.col("title")).alias("q"))


@on_news("F11_versions", r"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(lower(title), '\b([a-z][a-z0-9-]{1,24})\s*[- ]?\s*(\d+(?:\.\d+){1,3})\b', 1), regexp_extract_all(lower(title), '\b([a-z][a-z0-9-]{1,24})\s*[- ]?\s*(\d+(?:\.\d+){1,3})\b', 2)), lambda x: x[1] || ':' || x[2]))), ',') AS v FROM news")
def versions(spark, sf):
    return news(spark, sf).select("item_id", F.array_join(T.versions(F.col("title")), ",").alias("v"))


@on_news("F11_modalities", "SELECT item_id, CASE WHEN regexp_matches(lower(title), '\\b(announce[ds]?|announces|releases?|released|launch|launches|launched|introduces?|introduced)\\b') OR regexp_matches(title, '发布|宣布|推出|上线') THEN 'announced' WHEN regexp_matches(lower(title), '\\b(denies|denied|rejects|rejected)\\b') THEN 'denied' ELSE '' END AS m FROM news")
def modalities(spark, sf):
    return news(spark, sf).select("item_id", F.array_join(T.modalities(F.col("title")), ",").alias("m"))


@on_news("P8_stock_move", "SELECT item_id, regexp_matches(lower(title), 'why is .*stock sliding today|going on with .*stock|stock price up [0-9.]+%') OR regexp_matches(title, '股价今日|股价异动') AS move FROM news")
def stock_move(spark, sf):
    return news(spark, sf).select("item_id", T.stock_move(F.col("title")).alias("move"))


@on_news("F16_trading_day", "SELECT item_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM news")
def trading_day(spark, sf):
    return news(spark, sf).select("item_id", F.date_format(T.trading_day(F.col("ts")), "yyyy-MM-dd").alias("day"))


@on_news("F22_problem", r"""SELECT item_id, CASE WHEN regexp_matches(title, '[\p{Han}] ?[#*`~{}<>^] ?[\p{Han}]') THEN 'stray_symbol' WHEN contains(title, '核心F核心') THEN 'echo' WHEN contains(title, '哈哈哈哈') THEN 'repetition'
  WHEN len(title) - len(replace(title, '(', '')) <> len(title) - len(replace(title, ')', '')) THEN 'unbalanced_(' END AS problem FROM news""")
def problem(spark, sf):
    return news(spark, sf).select("item_id", T.problem(F.col("title")).alias("problem"))


@on_news("F23_sound_lines", "SELECT user_id, count(*) FILTER (NOT regexp_matches(title, '异>异|核心F核心|哈哈哈哈|\\(bracket')) AS sound, count(*) FILTER (regexp_matches(title, '异>异|核心F核心|哈哈哈哈|\\(bracket')) AS garbled FROM news GROUP BY user_id")
def sound_lines(spark, sf):
    reports = news(spark, sf).groupBy("user_id").agg(F.array_join(F.collect_list("title"), "\n").alias("report"))
    lines = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: x != ""))
    return reports.select("user_id", lines(T.sound_lines(F.col("report"))).cast("bigint").alias("sound"), F.size(T.garbled_lines(F.col("report"))).cast("bigint").alias("garbled"))


@on_news("F25_display_title", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '译文 ' || item_id ELSE title END AS shown FROM news")
def display_title(spark, sf):
    i = F.col("item_id")
    given = F.when(i % 3 == 0, F.concat(F.lit("译文 "), i.cast("string"))).when(i % 3 == 1, F.lit("坏（文")).otherwise(F.lit(" "))
    return news(spark, sf).select("item_id", T.display_title(F.col("title"), given).alias("shown"))


@on_news("F29_markdown", r"SELECT item_id, regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '([\\`*_\[\]<>|#])', '\\\1', 'g') AS m FROM news")
def markdown(spark, sf):
    return news(spark, sf).select("item_id", T.markdown_text(F.col("title")).alias("m"))


@on_news("F32_like", r"SELECT item_id, replace(replace(title, '%', '\%'), '_', '\_') AS p FROM news")
def like_pattern(spark, sf):
    return news(spark, sf).select("item_id", T.like_escaped(F.col("title")).alias("p"))


@on_news("F33_labels", "SELECT item_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age, CASE WHEN value < 50 THEN 'low' WHEN value < 70 THEN 'middle' ELSE 'high' END AS band FROM (SELECT *, epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM news)")
def labels(spark, sf):
    age = F.lit(1706745600) - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return news(spark, sf).select("item_id", T.age_label(age).alias("age"), T.score_band(F.col("value")).alias("band"))


@on_news("F20_document_kind", "SELECT item_id, CASE source_type WHEN 'sec' THEN 'filing' WHEN 'hkex' THEN 'exchange_announcement' WHEN 'cls' THEN 'flash' WHEN 'sina' THEN 'flash' ELSE 'article' END AS kind FROM news")
def document_kind(spark, sf):
    return news(spark, sf).select("item_id", T.document_kind(F.col("source_type"), F.col("event_type"), F.lit("http://a/b")).alias("kind"))


@query("F21_quality", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'title_only' WHEN len(trim(text)) < 400 THEN 'summary' ELSE 'full_text' END AS extent, len(trim(coalesce(text, ''))) >= 20000 AS truncated FROM documents")
def quality(spark, sf):
    return T_(spark, sf, "documents").select("doc_id", T.quality(F.col("text"), F.lit("t"), 20_000).alias("q")).select("doc_id", "q.extent", "q.truncated")


@query("F31_short_name", r"SELECT c_custkey, 'Acme ' || (c_custkey % 7) AS name FROM customer")
def short_name(spark, sf):
    k = F.col("c_custkey")
    form = F.element_at(F.array(*[F.lit(x) for x in (", Inc.", " Corp", " Holdings Ltd", " Group plc", " Co., Ltd.", " Class A Common Stock", "")]), (k % 7 + 1).cast("int"))
    return T_(spark, sf, "customer").select("c_custkey", T.short_name(F.concat(F.lit("Acme "), (k % 7).cast("string"), form)).alias("name"))


@query("F35_failure_kind", "SELECT event_id, ['content_filter', 'quota', 'rate_limited', 'rate_limited', 'timeout', 'auth', 'auth', 'server', 'connection', 'other', 'content_filter'][event_id % 11 + 1] AS kind FROM events")
def failure_kind(spark, sf):
    cases = [("error 1301", "APIError", 400), ("code 1113", "APIError", 429), ("slow down", "APIError", 429), ("code 1303", "X", None), ("", "ReadTimeout", None), ("no", "APIError", 403), ("", "AuthenticationError", None), ("down", "APIError", 503), ("", "ConnectionError", None), ("", "ValueError", None), ("contentFilter hit", "RateLimitError", 429)]
    case = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).alias("n"), F.lit(s).cast("int").alias("s")) for t, n, s in cases]), (F.col("event_id") % 11 + 1).cast("int"))
    return T_(spark, sf, "events").select("event_id", X.failure_kind(case["t"], case["n"], case["s"]).alias("kind"))


@query("F1_normal_url", "SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') || CASE WHEN contains(url, '?') THEN coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: NOT starts_with(lower(p), 'utm_') AND contains(p, '=')), '&'), ''), '') ELSE '' END AS u FROM pages")
def normal_url(spark, sf):
    return T_(spark, sf, "pages").select("page_id", X.normal_url(F.col("url")).alias("u"))


@query("F2_same_page", r"SELECT CASE WHEN regexp_matches(url, '^[a-z]+://[^/]+/[^?#]') THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '') || regexp_extract(url, '^[^?#]*(.*)$', 1) ELSE url END AS page, count(*) AS n FROM pages GROUP BY 1")
def same_page(spark, sf):
    return T_(spark, sf, "pages").groupBy(X.same_page(F.col("url")).alias("page")).agg(F.count("*").alias("n"))


# Times


@query("F14_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS t FROM events")
def utc_text(spark, sf):
    return T_(spark, sf, "events").select("event_id", C.utc_text(F.col("ts")).alias("t"))


@query("F15_publication", f"SELECT event_id, strftime(CASE WHEN event_id % 4 = 0 THEN ts WHEN event_id % 4 = 1 THEN ts - INTERVAL 2 HOUR ELSE ts END, {TS_SQL}) AS at, CASE event_id % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'accepted' WHEN 2 THEN 'observed' ELSE 'published' END AS basis FROM events")
def publication(spark, sf):
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    published = F.when(k == 0, ts).when(k == 1, ts + F.expr("INTERVAL 1 DAY")).when(k == 3, ts)
    at, basis = X.publication(published, F.when(k == 1, ts - F.expr("INTERVAL 2 HOURS")), ts, ts + F.expr("INTERVAL 1 HOUR"))
    return T_(spark, sf, "events").select("event_id", F.date_format(at, TS).alias("at"), basis.alias("basis"))


@query("F18_day_window", "SELECT event_id, strftime(timezone('UTC', timezone('Asia/Shanghai', date_trunc('day', timezone('Asia/Shanghai', timezone('UTC', ts))))), '%Y-%m-%d %H:%M:%S') AS started FROM events")
def day_window(spark, sf):
    start, _ = C.day_window(C.local_day(F.col("ts"), "Asia/Shanghai"), "Asia/Shanghai")
    return T_(spark, sf, "events").select("event_id", F.date_format(start, TS).alias("started"))


@query("F13_source_time", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'missing_timezone' WHEN 2 THEN 'missing' WHEN 3 THEN 'valid' WHEN 4 THEN 'invalid' ELSE 'valid' END AS status,
  CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000000Z') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000000Z') END AS utc, CASE event_id % 6 WHEN 0 THEN 'second' WHEN 3 THEN 'second' WHEN 5 THEN 'date' ELSE 'unknown' END AS precision FROM events""")
def source_time(spark, sf):
    k, ts = F.col("event_id") % 6, F.col("ts")
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("string")).when(k == 4, "not a time").when(k == 5, F.date_format(ts, "yyyy-MM-dd"))
    kind = F.when(k == 3, "epoch_s").when(k == 5, "date").otherwise("iso")
    zone = F.when(k == 5, "UTC")
    parsed = C.source_time()(raw, kind, zone, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return T_(spark, sf, "events").select("event_id", parsed.alias("p")).select("event_id", "p.status", "p.utc", "p.precision")


# Links, topics, themes


COMPANIES = {"amd": ["AMD"], "apple": ["Apple", "苹果", "AAPL"], "meta": ["Meta"], "nvidia": ["Nvidia", "英伟达"], "onsemi": ["=ON"], "tsmc": ["TSMC", "台积电"], "oracle": ["Oracle", "甲骨文"]}
_LINKED = """SELECT item_id, array_to_string(list_filter([CASE WHEN regexp_matches(title, '(^|[^A-Za-z0-9])AMD') AND NOT contains(title, 'Wet AMD') THEN 'amd' END, CASE WHEN contains(title, 'Apple Inc') THEN 'apple' END, CASE WHEN contains(title, 'Meta ') THEN 'meta' END,
  CASE WHEN contains(title, 'Nvidia') OR contains(title, '英伟达') THEN 'nvidia' END, CASE WHEN contains(title, 'ON Semi') THEN 'onsemi' END, CASE WHEN contains(title, '台积电') THEN 'tsmc' END, CASE WHEN contains(title, 'Oracle') OR contains(title, '甲骨文') THEN 'oracle' END], lambda x: x IS NOT NULL), ',') AS companies FROM news"""


@on_news("J15_companies", _LINKED)
def companies(spark, sf):
    return L.link_companies(news(spark, sf), "title", COMPANIES).select("item_id", F.array_join("companies", ",").alias("companies"))


@on_news("P7_sense", "SELECT item_id, title NOT LIKE '%Wet AMD%' AS amd, title = 'Apple Inc reports Q3 2025 earnings' AS apple, title LIKE 'Meta announced%' AS meta FROM news")
def senses(spark, sf):
    t = F.col("title")
    return news(spark, sf).select("item_id", *[T.sense(a, t).alias(a) for a in ("amd", "apple", "meta")])


@on_news("J16_relink", f"SELECT item_id, companies FROM ({_LINKED.replace('FROM news', 'FROM news WHERE ts >= TIMESTAMP ' + chr(39) + '2024-01-15' + chr(39))}) WHERE companies LIKE '%nvidia%'")
def relink(spark, sf):
    recent = L.relink(news(spark, sf), "title", "ts", "2024-01-15", COMPANIES, ["nvidia"])
    return recent.select("item_id", F.array_join("companies", ",").alias("companies"))


TOPICS = [
    {"slug": "chips", "keywords": ["chip", "chips", "芯片", "GPU"], "categories": [], "events": []},
    {"slug": "models", "keywords": ["model", "GPT", "Llama"], "categories": ["ai"], "events": ["purchase"]},
    {"slug": "vision", "keywords": ["AMD"], "categories": [], "events": []},
]


@on_news("D1_topics", r"""SELECT item_id, topic, evidence FROM (SELECT item_id, unnest(['chips', 'models', 'vision']) AS topic, unnest([
   array_to_string(list_filter([CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])chip($|[^A-Za-z0-9])') THEN 'chip' END, CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])chips($|[^A-Za-z0-9])') THEN 'chips' END, CASE WHEN contains(title, '芯片') THEN '芯片' END, CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])gpu($|[^A-Za-z0-9])') THEN 'GPU' END], lambda x: x IS NOT NULL), '|'),
   array_to_string(list_filter([CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])model($|[^A-Za-z0-9])') THEN 'model' END, CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])gpt($|[^A-Za-z0-9])') THEN 'GPT' END, CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])llama($|[^A-Za-z0-9])') THEN 'Llama' END, CASE WHEN source_type = 'rss' THEN '分类:ai' END, CASE WHEN event_type = 'purchase' THEN '事件:purchase' END], lambda x: x IS NOT NULL), '|'),
   CASE WHEN contains(title, 'AMD') AND NOT contains(title, 'Wet AMD') THEN 'AMD' ELSE '' END]) AS evidence FROM news) WHERE evidence <> ''""")
def topics(spark, sf):
    items = news(spark, sf).withColumn("category", F.when(F.col("source_type") == "rss", "ai"))
    return L.assign_topics(items, ["title"], TOPICS).select("item_id", "topic", F.array_join("evidence", "|").alias("evidence"))


def _themes_sql() -> str:
    chips = f"(regexp_matches(t, {re2(T.any_of(T.CHIPS[0].split(' ')))}) OR regexp_matches(t, {word_sql(T.CHIPS[1])}))"
    each = []
    for name, (inside, words) in T.THEMES.items():
        found = f"(regexp_matches(t, {re2(T.any_of(inside.split(' ')).lower())}) OR regexp_matches(t, {word_sql(words)}))"
        each.append(f"CASE WHEN {found}{' AND ' + chips if name in T.CHIP_THEMES else ''} THEN '{name}' END")
    return f"SELECT item_id, array_to_string(list_filter([{', '.join(each)}], lambda x: x IS NOT NULL), ',') AS themes FROM (SELECT *, lower(title) AS t FROM news)"


@on_news("D2_themes", _themes_sql())
def themes(spark, sf):
    return news(spark, sf).select("item_id", F.array_join(T.themes(F.col("title")), ",").alias("themes"))


@on_news("J14_topic_tags", "SELECT topic, count(*) AS items, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT item_id, user_id, 'chips' AS topic FROM news WHERE regexp_matches(lower(title), '(^|[^a-z0-9])(chips?|gpu)($|[^a-z0-9])') OR contains(title, '芯片')) GROUP BY topic")
def topic_tags(spark, sf):
    items = news(spark, sf).withColumn("category", F.lit(None).cast("string"))
    tags = L.assign_topics(items, ["title"], TOPICS[:1])
    return L.tagged(items, tags).groupBy("topic").agg(F.count("*").alias("items"), F.count_distinct("user_id").alias("users"))


# Stories


@query("D5_match_score")
def match_score(spark, sf):
    """Every page, the first page of its title, and how many pages tell the same news."""
    return Y.settle(articles(spark, sf), ["class_id", "n_links"])


@query("D6_story_clusters")
def story_clusters(spark, sf):
    """Every page and the page that began its story."""
    return Y.settle(articles(spark, sf), ["anchor"])


@query("D7_merged_stories")
def merged_stories(spark, sf):
    """Every page, its story, and its story after merges."""
    return Y.cluster(articles(spark, sf))


@query("D9_same_event", """WITH RECURSIVE hot AS (SELECT c_custkey AS story, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), judged AS (SELECT a.user_id AS a, b.user_id AS b FROM (SELECT DISTINCT user_id FROM events WHERE value > 60) a JOIN (SELECT DISTINCT user_id FROM events WHERE value > 60) b ON b.user_id = a.user_id + 3 WHERE a.user_id % 2 = 0),
  edges AS (SELECT a, b FROM judged WHERE a IN (SELECT story FROM hot) AND b IN (SELECT story FROM hot) UNION SELECT b, a FROM judged WHERE a IN (SELECT story FROM hot) AND b IN (SELECT story FROM hot)),
  reach AS (SELECT story AS a, story AS b FROM hot UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a) SELECT r.a AS story, arg_min(r.b, h.rank) AS first FROM reach r JOIN hot h ON h.story = r.b GROUP BY r.a""")
def same_event(spark, sf):
    from pyspark.sql import Window

    hot = T_(spark, sf, "customer").select(F.col("c_custkey").alias("story"), F.row_number().over(Window.orderBy(F.col("c_acctbal").desc(), "c_custkey")).alias("rank"))
    of = T_(spark, sf, "events").where("value > 60").select(F.col("user_id").alias("a")).distinct()
    judged = of.where("a % 2 = 0").withColumn("b", F.col("a") + 3).join(of.select(F.col("a").alias("b")), "b", "left_semi").withColumn("same", F.lit(True))
    return Y.same_event(hot, judged)


@query("J11_hot_pairs", """, s AS (SELECT story_id, max(coalesce(score, 50)) AS heat, min(published_at) AS first_at, list_distinct(list(company)) AS companies FROM items WHERE story_id IS NOT NULL GROUP BY story_id),
  h AS (SELECT *, row_number() OVER (ORDER BY heat DESC, story_id) AS r FROM s QUALIFY r <= 40)
  SELECT a.story_id AS a, b.story_id AS b FROM h a JOIN h b ON a.r < b.r AND list_has_any(a.companies, b.companies) AND abs(epoch_us(a.first_at) - epoch_us(b.first_at)) <= 172800000000 WHERE (a.r + b.r) % 7 <> 0 ORDER BY a.r, b.r LIMIT 60""", True)
def hot_pairs(spark, sf):
    s = R.items(spark, sf).where("story_id is not null").groupBy("story_id").agg(F.max(F.coalesce("score", F.lit(50))).alias("heat"), F.min("published_at").alias("first_at"), F.collect_set("company").alias("companies"))
    return L.hot_pairs(s, 40, 48, 60, lambda a, b: (a + b) % 7 == 0).select("a", "b")


@query("D10_event_match")
def event_match(spark, sf):
    """Each item's headline as a proposal against the headline seven places on, with the facts that titles tell."""
    from .operators import matching

    n = len(HEADLINES)
    pairs = spark.createDataFrame([(i, HEADLINES[i], HEADLINES[(i + 7 * k) % n], k) for i in range(n) for k in range(3)], "i int, a_title string, b_title string, k int")
    items = news(spark, sf).select("item_id", (F.col("item_id") % n).cast("int").alias("i"), (F.floor(F.col("item_id") / n) % 3).cast("int").alias("k"), "event_type", "ts")
    typed = items.join(F.broadcast(pairs), ["i", "k"])  # as many pairs as headlines
    entities = lambda m: F.when(F.col("item_id") % m == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), (F.col("item_id") % 4).cast("string"))))
    none = F.array().cast("array<string>")
    facts = F.when(F.col("item_id") % 13 == 0, F.array(F.lit("f"))).otherwise(none)
    asked = typed.select(
        "item_id", "a_title", "b_title", F.col("event_type").alias("a_type"), F.when(F.col("k") == 2, "other").otherwise(F.col("event_type")).alias("b_type"), entities(3).alias("a_entities"), entities(5).alias("b_entities"),
        F.col("ts").alias("a_time"), (F.col("ts").cast("timestamp") + F.make_dt_interval((F.col("item_id") % 60).cast("int"))).alias("b_time"), none.alias("a_periods"), none.alias("b_periods"), none.alias("a_versions"), none.alias("b_versions"), none.alias("a_modalities"), none.alias("b_modalities"), facts.alias("a_facts"), facts.alias("b_facts"),
    )
    return matching.assess(asked).select("item_id", "decision", "score", "reason")
ORACLES.pop("D10_event_match", None)
