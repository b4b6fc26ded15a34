"""What titles say: normal forms, headlines, periods and versions, daily stock-move pieces, aliases and their senses, themes, garbled text.

Column expressions only. Word lists and patterns under "fixed values" must equal what users of such feeds rely on.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean the same in titles of stories and of events.
STORY_SAME = {"人工智能": "ai", "发布": "推出", "上线": "推出"}
STORY_LAUNCH = "launches launched releases released introduces introduced".split()
EVENT_SAME = {"人工智能": "ai", "发布": "announce", "宣布": "announce", "推出": "launch", "上线": "launch", "否认": "deny", "季度业绩": "quarter results", "财报": "earnings"}
EVENT_ANNOUNCE = "announce announces announced release releases released launch launches launched introduce introduces introduced".split()
EVENT_DENY = "denies denied rejects rejected".split()
#: Sources that put a headline in brackets before the text, and the dateline of a wire.
BRACKET_SOURCES = ("sina", "wscn_live")
DATELINE = r"^财联社\d{1,2}月\d{1,2}日电[，,]\s*"
# How daily pieces on a stock's move are titled.
MOVES = "up down rising falling sliding climbing rallying surging gaining dropping jumping soaring sinking tumbling trading popping plunging slumping jumped dropped fell rose soared sank popped plunged surged tumbled slid climbed rallied gained slumped crashed reversed".split()
VERBS = "up down rise rises fall falls gain gains drop drops jump jumps slide slides sink sinks soar soars climb climbs tumble tumbles surge surges plunge plunges rallies underperforms outperforms".split()
DAYS = r"(?:today|tonight|this\s+(?:morning|afternoon|week)|overnight|pre-?market|after[\s-]hours|monday|tuesday|wednesday|thursday|friday)"
# Theme -> phrases found anywhere, phrases found as whole words.
THEMES = {
    "export_controls": ("出口管制 出口限制 实体清单 芯片禁令 芯片出口 技术封锁 走私", "export control|export controls|entity list|chip ban|export curbs|bis rule|smuggling|smuggle|smuggled"),
    "ai_capex": ("资本开支 资本支出 算力投资 数据中心投资 算力采购", "capex|capital expenditure|capital spending|hyperscaler|ai spending|ai infrastructure"),
    "capacity_supply": ("产能 扩产 晶圆厂 代工 先进封装 良率 供应链 缺货 交期", "production capacity|chip capacity|capacity expansion|foundry|fab|fabs|wafer|wafers|cowos|advanced packaging|supply chain|chip shortage|lead times"),
    "memory": ("存储芯片 内存 闪存 存储器", "hbm|hbm3|hbm3e|hbm4|hbm4e|dram|nand|memory chip|memory chips|memory prices|flash memory"),
    "equipment_materials": ("光刻机 光刻 刻蚀 半导体设备 晶圆设备 硅片 半导体材料", "lithography|euv|etch|chip equipment|chipmaking equipment|semiconductor equipment|wafer fab equipment"),
    "datacenter_power": ("数据中心 智算中心 液冷 电力供应 电网 算力中心", "data center|data centers|datacenter|power grid|liquid cooling|power demand"),
    "end_demand": ("出货量 手机出货 PC 出货 PC出货 需求疲软 需求回暖 换机", "shipments|smartphone sales|pc sales|pc shipments|consumer demand"),
    "industry_data": ("半导体销售额 芯片销售额 费城半导体 半导体指数 晶圆代工营收", "semiconductor industry association|wsts|semiconductor sales|chip sales|philadelphia semiconductor|sox index"),
    "rates": ("美联储 加息 降息 利率决议 联邦基金利率 鲍威尔 议息 央行", "federal reserve|fed|fomc|rate cut|rate cuts|rate hike|interest rates|powell"),
    "inflation_jobs": ("通胀 非农 就业数据 失业率 初请失业金", "cpi|pce|inflation|nonfarm|payrolls|jobs report|unemployment rate"),
    "markets": ("标普500 标普 500 纳斯达克指数 纳指 道指 道琼斯 美股收盘 美股三大指数", "s&p 500|nasdaq composite|dow jones|stocks close|us stocks"),
    "bonds_fx": ("美债 国债收益率 美元指数 汇率 人民币汇率", "treasury yield|treasury yields|bond yields|dollar index|us dollar"),
    "trade_geopolitics": ("关税 贸易战 贸易协议 制裁 地缘 军事冲突 停火", "tariff|tariffs|trade war|trade deal|sanctions|geopolitical"),
}
CHIP_THEMES = ("export_controls", "capacity_supply", "end_demand")
CHIPS = ("芯片 半导体 晶圆 算力 存储 服务器 人工智能 电子 台积电 英伟达 中芯 海力士 美光 三星电子", "chip|chips|semiconductor|semiconductors|wafer|gpu|gpus|ai|server|servers|memory|electronics|nvidia|tsmc")
MACRO_THEMES = ("rates", "inflation_jobs", "markets", "bonds_fx", "trade_geopolitics")


def quoted(word: str) -> str:
    """A word as a regular expression that Java and RE2 read alike."""
    return "".join("\\" + c if not c.isalnum() and c not in " _-" and c.isascii() else c for c in word)


def any_of(words: Iterable[str]) -> str:
    return "|".join(quoted(w) for w in words)


def _replaced(text: Column, same: dict[str, str]) -> Column:
    for word, other in same.items():
        text = F.replace(text, F.lit(word), F.lit(other))
    return text


def story_title(title: Column) -> Column:
    """A title for comparing articles: lower case, launch words alike, nothing but letters and digits. (Java lowers ß and İ otherwise than full case folding.)"""
    text = F.regexp_replace(_replaced(F.lower(title), STORY_SAME), rf"(?U)\b(?:{any_of(STORY_LAUNCH)})\b", "launch")
    return F.regexp_replace(text, r"(?U)[\W_]+", "")


def event_title(title: Column) -> Column:
    """A title for comparing events: announcing and denying words alike, nothing but letters, digits and underscores."""
    text = F.regexp_replace(_replaced(F.lower(title), EVENT_SAME), rf"(?U)\b(?:{any_of(EVENT_ANNOUNCE)})\b", " announce ")
    text = F.regexp_replace(text, rf"(?U)\b(?:{any_of(EVENT_DENY)})\b", " deny ")
    return F.regexp_replace(text, r"(?U)[^\w]+", "")


def undated(title: Column) -> Column:
    return F.regexp_replace(title, DATELINE, "")


def headline(title: Column, source_type: Column) -> Column:
    """The headline as a wire wrote it, in normal form: that in brackets for sources that write so. Wants titles in NFKC."""
    bare = F.trim(undated(title))
    bracketed = F.regexp_extract(bare, "^【([^】]+)】", 1)
    return story_title(F.when(source_type.isin(*BRACKET_SOURCES) & (bracketed != ""), bracketed).otherwise(bare))


def stock_move(title: Column) -> Column:
    """Whether a title is a daily piece on a stock's move: one template, other news each day."""
    moves = rf"(?:{any_of(MOVES)})"
    english = [
        rf"\bwhy\b.{{0,60}}?\bstocks?\b.{{0,40}}?\b{DAYS}\b",
        rf"\bwhy\s+(?:is|are)\s+.{{1,60}}?\bstocks?\s+{moves}\b",
        rf"\bstocks?\s+just\s+{moves}\b",
        rf"\bwhy\b.{{0,60}}?\bstocks?\s+(?:keeps?|continues?)\s+(?:going\s+)?{moves}\b",
        r"(?:what'?s|what\s+is)\s+going\s+on\s+with\s+.{1,80}?\bstock\b",
        rf"\bstock\b.{{0,40}}\b{DAYS}\b.{{0,20}}(?:here(?:'s|\s+is)\s+(?:why|what\s+happened)|what'?s\s+going\s+on)",
        r"\bstock\s+trades\s+(?:up|down)\b",
        r"\bstock\s+price\s+(?:(?:up|down)\s+[\d.]+%|ended\s+at\b)",
        rf"\b(?:green|red)\s+day\s+on\s+{DAYS}\s+for\b",
        r"\b(?:qqq|spy|voo|dia|iwm)\s+is\s+(?:up|down)\b",
        rf"\bstock\s+(?:price\s+)?(?:is\s+)?(?:{any_of(VERBS)})\b.{{0,40}}\b{DAYS}\b",
        r"\b(?:rise|rises|fall|falls|decline|declines|dip|dips|gain|gains)\s+(?:higher|more\s+steeply|less)\s+than\s+(?:the\s+)?(?:broader\s+)?market\b",
    ]
    chinese = "股价(?:今日|今天|周[一二三四五六日]|本周)|(?:今日|今天|周[一二三四五])股价|股价(?:异动|动态|走势如何)|股价.{0,8}发生了什么|(?:盘前|盘后|隔夜)股价|股价(?:盘前|盘后|隔夜)"
    found = title.rlike(chinese)
    for pattern in english:
        found = found | title.rlike("(?i)" + pattern)
    return found


def trading_day(published: Column) -> Column:
    """The calendar day in New York on which a piece came out; published is in UTC."""
    return F.to_date(F.from_utc_timestamp(published, "America/New_York"))


def quarter(text: Column) -> Column:
    """The quarter that a text names in English or Chinese, as YYYY-Qn; null if none."""
    low = F.lower(text)
    found = None
    for pattern, year, number in ((r"\b(?:q|quarter\s*)([1-4])\D{0,12}(20\d{2})\b", 2, 1), (r"\b(20\d{2})\D{0,12}(?:q|quarter\s*)([1-4])\b", 1, 2), (r"(20\d{2})\s*年?\s*第?([一二三四1234])季度", 1, 2)):
        y, n = F.regexp_extract(low, pattern, year), F.translate(F.regexp_extract(low, pattern, number), "一二三四", "1234")
        one = F.when(y != "", F.concat(y, F.lit("-Q"), n))
        found = one if found is None else F.coalesce(found, one)
    return found


def versions(title: Column) -> Column:
    """product:version of each product with a dotted version in a title, sorted."""
    pattern = r"\b([a-z][a-z0-9-]{1,24})\s*[- ]?\s*(\d+(?:\.\d+){1,3})\b"
    low = F.lower(title)
    names, numbers = (F.regexp_extract_all(low, F.lit(pattern), F.lit(i)) for i in (1, 2))
    named = F.filter(F.arrays_zip(names.alias("n"), numbers.alias("v")), lambda x: ~x["n"].isin("q", "fy", "year", "quarter"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda x: F.concat_ws(":", x["n"], x["v"]))))


def modalities(title: Column) -> Column:
    """Whether a title denies or announces, as a sorted array."""
    text = event_title(title)
    said = F.array(F.when(text.contains("announce") | text.contains("launch"), "announced"), F.when(text.contains("deny"), "denied"))
    return F.filter(said, lambda x: x.isNotNull())


def whole_word(word: str) -> str:
    return rf"(?<![A-Za-z0-9]){quoted(word)}(?![A-Za-z0-9])"


def names(text: Column, alias: str) -> Column:
    """Whether an alias stands in a text and means the company there; a leading '=' minds case, ASCII aliases are whole words."""
    word = alias[1:] if alias.startswith("=") and len(alias) > 1 else alias
    pattern = whole_word(word) if word.isascii() else quoted(word)
    return text.rlike(pattern if word is not alias else "(?i)" + pattern) & sense(word, text)


def sense(alias: str, text: Column) -> Column:
    """Whether an alias that also names something else means the company in a text (fixed values)."""
    key = alias.lower()
    products = r"(?i)\biPhone|\biPad|\bMac(?:Book|OS|s)?\b|\b(?:iOS|watchOS|visionOS)\b|Vision Pro|App Store|AirPods|\bApple (?:Inc|Watch|TV|Music|Pay|Intelligence|stock|shares)|Cupertino|Tim Cook|\$?AAPL\b"
    fruit = r"(?i)(?<!-to-)\bapples\b(?!-to-)|orchard|cider|crab ?apple|\bBig Apple\b|\bApple Cup\b|\b(?:candy|caramel|toffee) apples?\b|\bapple (?:pie|picking|festival|fest|harvest|tree|variet\w*|grower|crop|juice|butter|sauce|season|farm\w*)s?\b"
    if key == "amd":
        return ~text.rlike(r"(?i)\b(?:wet|dry|neovascular|exudative|atrophic)[- ]AMD\b|\bnAMD\b|macula|retina|ophthalm|intravitreal|geographic atrophy")
    if key == "apple":
        return text.rlike(products) | (text.rlike("(?<![A-Za-z0-9])(?:Apple|APPLE)(?![A-Za-z0-9])") & ~text.rlike(fruit))
    if key == "苹果":
        return text.rlike(products) | ~text.rlike("苹果(?:期货|园|树|汁|醋|派|种植|采摘|产区|果农)|果园|果农|水果|红富士|烟台苹果|阿克苏|洛川")
    if key == "meta":
        return text.rlike("(?<![A-Za-z0-9])(?:Meta|META)(?![A-Za-z0-9])(?!-(?:analys|regress|review))")
    return F.lit(True)


def themes(text: Column) -> Column:
    """The market themes whose phrases a text has, in their order; three of them count only next to a word on chips."""

    def found(phrases: tuple[str, str]) -> Column:
        inside, words = phrases
        return text.rlike("(?i)" + any_of(x.replace(" ", " ") for x in inside.split(" ")) + rf"|(?<![a-z0-9-])(?:{any_of(words.split('|'))})(?![a-z0-9-])")

    chips = found(CHIPS)
    each = [F.when(found(p) & (chips if name in CHIP_THEMES else F.lit(True)), name) for name, p in THEMES.items()]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def theme_scope(theme: Column) -> Column:
    return F.when(theme.isin(*MACRO_THEMES), "macro").otherwise("industry")


HAN = "㐀-䶿一-鿿"
#: Opening and closing characters that must be as many (fixed values).
PAIRS = ("（）", "“”", "《》", "「」", "【】", "()", "[]")


def problem(text: Column) -> Column:
    """Why a text looks garbled, first match first; null if it looks fine or is empty."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    out = (
        F.when(text.rlike("[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f​⁠﻿]"), "invisible_character")
        .when(text.rlike(rf"[{HAN}] ?[#*`~\\{{}}<>^] ?[{HAN}]"), "stray_symbol")
        .when(text.rlike(rf"([{HAN}]{{2,4}})[A-Za-z0-9#*>)(\]\[]\1"), "echo")
        .when(text.rlike("[Ѐ-ӿ֐-׿؀-ۿऀ-ॿ฀-๿가-힯぀-ヺヽ-ヿ]"), "foreign_script")
        .when(text.rlike(rf"([{HAN}])\1{{3,}}|([{HAN}]{{2,6}})\2{{2,}}"), "repetition")
    )
    for a, b in PAIRS:
        out = out.when(count(a) != count(b), "unbalanced_" + a)
    return out


def sound_lines(text: Column) -> Column:
    """A report without its garbled lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: problem(line).isNull()), "\n")


def garbled_lines(text: Column) -> Column:
    """The garbled lines of a report, each with what is wrong."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), problem(line).alias("problem")))
    return F.filter(lines, lambda x: x["problem"].isNotNull())


def display_title(title: Column, translation: Column) -> Column:
    """The translation if it is there and not garbled, else the title."""
    return F.when((F.coalesce(F.trim(translation), F.lit("")) != "") & problem(translation).isNull(), translation).otherwise(title)


def markdown_text(text: Column) -> Column:
    """A text safe within markdown: one line, marks escaped."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"([\\`*_\[\]<>|#])", r"\\$1")


def short_name(name: Column, rounds: int = 4) -> Column:
    """A company's name without the legal forms at its end, taken off one after another."""
    form = r"(?i)[,\s]+(?:inc|incorporated|corp|corporation|co|company|ltd|limited|plc|llc|lp|holdings?|group|n\.?v|s\.?a|ag|se|class\s+[a-z]|common\s+stock|ordinary\s+shares|adr|ads)\.?$"
    out = F.trim(name)
    for _ in range(rounds):
        out = F.trim(F.regexp_replace(out, form, ""))
    return out


def like_escaped(text: Column) -> Column:
    """A text as a LIKE pattern that matches itself, with a backslash for escape."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def age_label(seconds: Column) -> Column:
    """How long ago something was, in the largest unit that fits."""
    whole = lambda n: F.floor(seconds / n).cast("int").cast("string")
    return F.when(seconds < 60, "now").when(seconds < 3600, F.concat(whole(60), F.lit("m"))).when(seconds < 86_400, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86_400), F.lit("d")))


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score < 0, "refused").when(score < 50, "low").when(score < 70, "middle").otherwise("high")


def document_kind(source_type: Column, event_type: Column, url: Column) -> Column:
    """What kind of document an item is: a filing, an announcement of an exchange, a flash, an official post or an article."""
    return F.when(source_type == "sec", "filing").when(source_type == "hkex", "exchange_announcement").when(source_type.isin("cls", "wscn_live", "sina"), "flash").when((event_type == "official") | url.rlike(r"(?i)/(?:press|newsroom|investor)"), "official_post").otherwise("article")


def quality(text: Column, title: Column, most: int) -> Column:
    """A document's content: how much there is, whether it was cut, and where it comes from."""
    body = F.coalesce(F.trim(text), F.lit(""))
    extent = F.when(body == "", "title_only").when(F.length(body) < 400, "summary").otherwise("full_text")
    return F.struct(extent.alias("extent"), (F.length(body) >= most).alias("truncated"), F.when(body == F.trim(title), "title").otherwise("source").alias("origin"))
