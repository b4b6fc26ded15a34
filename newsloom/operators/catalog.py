"""Catalogues: versions, aliases and identifiers, overlays of published judgements, lists as of a time, sources and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the JSON of some columns in order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def append_versions(current: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Versions to append: incoming rows whose content differs from their key's latest version (key, version, sha).

    A key without a version gets its first. Incoming has each key once.
    """
    last = current.groupBy(key).agg(F.max("version").alias("last"), F.max_by("sha", "version").alias("before"))
    new = incoming.withColumn("sha", canonical(incoming, columns)).join(last, key, "left")
    return new.where(~F.col("sha").eqNullSafe(F.col("before"))).select(key, *columns, (F.coalesce("last", F.lit(0)) + 1).alias("version"), "sha")


def new_assertions(known: DataFrame, incoming: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Assertions (an alias or identifier of something) that are not known yet, each once."""
    return incoming.select(*columns).distinct().join(known.select(*columns), list(columns), "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, key: str, replace: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """target after incoming rows: a key's replaced columns come from incoming where it has the key, kept ones only where target has not."""
    t = target.select(F.col(key), F.struct(*replace, *keep).alias("t"))
    i = incoming.select(F.col(key), F.struct(*replace, *keep).alias("i"))
    both = t.join(i, key, "full")
    new = [F.when(F.col("i").isNotNull(), F.col("i")[c]).otherwise(F.col("t")[c]).alias(c) for c in replace]
    old = [F.when(F.col("t").isNotNull(), F.col("t")[c]).otherwise(F.col("i")[c]).alias(c) for c in keep]
    return both.select(key, *new, *old)


def overlay(items: DataFrame, key: str, pointers: DataFrame, publications: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """items with curated values: for each kind its legacy column, replaced where a pointer says so, and a state.

    pointers: key, kind, publication_id; publications: publication_id, status, value. A pointer to a published value takes its place
    (curated); one that is there but unusable hides the legacy value (unusable, null); without one the legacy value stays (legacy).
    """
    found = pointers.join(publications, "publication_id", "left")
    usable = F.coalesce(F.col("status") == "published", F.lit(False)) & F.col("value").isNotNull()
    wide = found.groupBy(key).pivot("kind", list(kinds)).agg(F.max(F.struct("publication_id", F.when(usable, F.col("value")).alias("value"))))
    out = items.join(wide, key, "left")
    for kind, legacy in kinds.items():
        state = F.when(F.col(kind).isNull(), "legacy").when(F.col(kind)["value"].isNull(), "unusable").otherwise("curated")
        out = out.withColumn(f"{legacy}_state", state).withColumn(legacy, F.when(F.col(kind).isNull(), F.col(legacy)).otherwise(F.col(kind)["value"])).drop(kind)
    return out


def contract_faults(payload: Column, fields: dict[str, str], choices: dict[str, Sequence[str]] | None = None) -> Column:
    """What is wrong with a JSON object under an exact contract: not an object, missing, unknown or mistyped fields, values outside their choices."""
    names = F.json_object_keys(payload)
    kinds = {"int": r"^-?\d+$", "bool": "^(true|false)$", "string": r"(?s)^.+$"}
    value = lambda n: F.get_json_object(payload, f"$.{n}")
    wrong = [F.when(names.isNull(), "object")]
    wrong += [F.when(names.isNotNull() & ~F.array_contains(names, n), "missing:" + n) for n in fields]
    wrong += [F.when(F.array_contains(names, n) & ~F.coalesce(value(n).rlike(kinds[k]), F.lit(False)), "type:" + n) for n, k in fields.items()]
    wrong += [F.when(value(n).isNotNull() & ~value(n).isin(*c), "choice:" + n) for n, c in (choices or {}).items()]
    wrong.append(F.when(F.size(F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in fields]))) > 0, "unknown"))
    return F.filter(F.array(*wrong), lambda x: x.isNotNull())


def fallback(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """rows with a value from the first mapping, or from the second where the first has none."""
    a = first.select(F.col(key), F.col(value).alias("_a"))
    b = second.select(F.col(key), F.col(value).alias("_b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def list_as_of(versions: DataFrame, key: str, as_of: Column, where: Column, after: object, limit: int) -> DataFrame:
    """A page of a list API: of each key the latest version known at a time, those that fit, after a key, in its order."""
    from .temporal import latest_as_of

    return latest_as_of(versions, [key], ["version"], as_of).where(where & (F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def stale_hashes(rows: DataFrame, columns: Sequence[str], stored: str) -> DataFrame:
    """Rows whose stored hash is not that of their content."""
    return rows.where(~canonical(rows, columns).eqNullSafe(F.col(stored)))


def pick_time(values: DataFrame, key: str) -> DataFrame:
    """Of each key's source times (ordinal, status, utc) the first valid one, else the first of all."""
    rank = F.struct(F.when(F.col("status") == "valid", 0).otherwise(1).alias("r"), "ordinal")
    return values.groupBy(key).agg(F.min_by(F.struct("ordinal", "status", "utc"), rank).alias("x")).select(key, "x.*")


def security_master(listings: DataFrame, screener: DataFrame) -> DataFrame:
    """One row for each company: its first ticker in normal form, with market cap and industry of the screener where known.

    listings: position, cik, ticker, name; screener: symbol, market_cap (text with signs), industry.
    """
    normal = lambda c: F.upper(F.translate(F.trim(c), "./", "--"))
    first = listings.withColumn("ticker", normal("ticker")).groupBy("cik").agg(F.min_by(F.struct("ticker", "name"), "position").alias("x")).select(F.lpad("cik", 10, "0").alias("cik"), "x.*")
    caps = screener.select(normal("symbol").alias("ticker"), F.regexp_replace("market_cap", "[$,]", "").try_cast("double").alias("market_cap"), "industry").dropDuplicates(["ticker"])
    return first.join(caps, "ticker", "left")


def replaced(before: DataFrame, after: DataFrame, key: str, least: int) -> DataFrame:
    """What replacing a table by a new one removes and adds, and whether the new one is large enough to be taken."""
    n = after.count()
    gone = before.select(key).join(after.select(key), key, "left_anti").select(key, F.lit("removed").alias("change"))
    come = after.select(key).join(before.select(key), key, "left_anti").select(key, F.lit("added").alias("change"))
    return gone.union(come).withColumn("accepted", F.lit(n >= least))


def source_changes(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """What becomes of each source: added, enabled or disabled, its channel changed (history is then reclassified), or nothing. Both: key, channel, enabled."""
    s = stored.select("key", F.col("channel").alias("was"), F.col("enabled").alias("on"))
    c = configured.select("key", F.col("channel").alias("now"), F.lit(True).alias("wanted"))
    action = F.when(F.col("on").isNull(), "add").when(F.col("wanted").isNull(), F.when(F.col("on"), "disable").otherwise("keep")).when(~F.col("on"), "enable").when(F.col("was") != F.col("now"), "reclassify").otherwise("keep")
    return s.join(c, "key", "full").select("key", action.alias("action"))


def worklist(items: DataFrame, texts: DataFrame, now: Column, since: Column, limit: int) -> DataFrame:
    """Recent items whose text was never fetched or whose retry is due, newest first. texts: item_id, status, retry_at."""
    due = F.col("status").isNull() | ((F.col("status") == "retry") & (F.col("retry_at") <= now))
    return items.join(texts, "item_id", "left").where((F.col("published_at") >= since) & due).orderBy(F.col("published_at").desc(), F.col("item_id").desc()).select("item_id", "published_at").limit(limit)


def category(headline: Column) -> tuple[Column, Column]:
    """Group and categories of an exchange's headline of the form 'group - [a / b]'."""
    group = F.trim(F.regexp_extract(headline, r"^([^\[]*?)\s*-\s*\[", 1))
    inside = F.regexp_extract(headline, r"\[([^\]]*)\]", 1)
    return group, F.filter(F.transform(F.split(inside, "/"), lambda x: F.trim(x)), lambda x: x != "")


def classified(headline: Column, rules: dict[str, str], title_rules: dict[str, str]) -> Column:
    """An event type from a headline's categories, or from patterns on all of it where no category tells."""
    _, cats = category(headline)
    out = None
    for name, event in rules.items():
        held = F.array_contains(cats, name)
        out = F.when(held, event) if out is None else out.when(held, event)
    for pattern, event in title_rules.items():
        out = out.when(headline.rlike("(?i)" + pattern), event)
    return out.otherwise("other")


def filing_type(codes: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """Event type of a filing from its item codes (whole codes, in order of the rules), and whether it is routine: all its codes are exhibits or schedules."""
    each = F.transform(F.split(F.coalesce(codes, F.lit("")), ","), lambda x: F.trim(x))
    out = None
    for code, event in rules.items():
        held = F.array_contains(each, code)
        out = F.when(held, event) if out is None else out.when(held, event)
    return out.otherwise("other"), F.forall(each, lambda c: c.isin("9.01", "7.01", ""))


def without_counters(record: DataFrame, counters: Sequence[str]) -> Column:
    """The hash of a record without its engagement counters, so that repeats are equal."""
    return canonical(record, [c for c in record.columns if c not in counters])


def query_news(entries: DataFrame, aliases: Column) -> DataFrame:
    """Entries of a search feed that name their company, without the publisher at the title's end, quote pages and community posts."""
    title = F.trim(F.regexp_replace("title", r"\s+-\s+[^-]+$", ""))
    quote = F.col("title").rlike(r"(?i)\bstock (?:price|quote)s?\b.*\b(?:quote|chart|today)\b|\((?:NASDAQ|NYSE):")
    community = F.col("url").rlike(r"(?i)(reddit|quora|stocktwits)\.com")
    named = F.exists(aliases, lambda a: F.contains(F.lower(F.concat(F.lit(" "), title, F.lit(" "))), F.concat(F.lit(" "), F.lower(a), F.lit(" "))))
    return entries.withColumn("clean", title).where(~quote & ~community & named)


def feed_entries(feeds: DataFrame, xml: str, most: int = 60) -> DataFrame:
    """feed columns with position, title, link, published and summary of each entry of an RSS text, at most some for each feed (the feature's bound).

    Titles and summaries are unescaped twice, as feeds escape what is escaped; summaries are cut to 400 characters of visible text. A feed
    without entries gives no row.
    """
    from ..functions.text import visible_text

    def unescaped(c: Column) -> Column:
        for _ in range(2):
            for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
                c = F.replace(c, F.lit(entity), F.lit(char))
        return c

    part = lambda n: F.regexp_extract(F.col("entry"), rf"(?s)<{n}>(.*?)</{n}>", 1)
    each = feeds.select(*[c for c in feeds.columns if c != xml], F.posexplode(F.slice(F.regexp_extract_all(F.col(xml), F.lit("(?s)<item>(.*?)</item>"), F.lit(1)), 1, most)).alias("position", "entry"))
    return each.select(*[c for c in feeds.columns if c != xml], "position", F.trim(visible_text(unescaped(part("title")))).alias("title"), F.trim(part("link")).alias("link"), F.trim(part("pubDate")).alias("published"), F.substring(visible_text(unescaped(part("description"))), 1, 400).alias("summary")).where("title <> '' and link <> ''")


def links(pages: DataFrame, html: str, pattern: str, least: int = 8, most: int = 40) -> DataFrame:
    """Page columns with href and title of anchors that fit a pattern and have a title of some length, each address once, the first ones of a page (the feature's bound)."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<a\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>'), F.lit(0))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("position", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", r'(?s)^<a\s[^>]*>(.*)</a>$', 1), "<[^>]*>", " "), r"\s+", " "))
    rows = rows.select("*", F.regexp_extract("a", r'href="([^"]+)"', 1).alias("href"), text.alias("title")).drop("a")
    rows = rows.where(F.col("href").rlike(pattern) & (F.length("title") >= least))
    keys = [c for c in pages.columns if c != html]
    first = rows.groupBy(*keys, "href").agg(F.min_by(F.struct("position", "title"), "position").alias("x")).select(*keys, "href", "x.*")
    w = Window.partitionBy(*keys).orderBy("position")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank", "position")


def missing_ids(companies: DataFrame, listings: DataFrame) -> DataFrame:
    """Companies without a number, with that of the listing of their ticker; two listings of one ticker give none."""
    by = listings.groupBy("ticker").agg(F.count_distinct("cik").alias("n"), F.min("cik").alias("found"))
    return companies.where("cik is null").join(by.where("n = 1"), "ticker").select("company", "ticker", F.col("found").alias("cik"))


def identified(entities: DataFrame, identifiers: DataFrame, scheme: str, value: str, qualifier: str, wanted: str) -> DataFrame:
    """Entities with an identifier of a scheme, a value, and a qualifier in its JSON."""
    fit = identifiers.where((F.col("scheme") == scheme) & (F.col("value") == value) & (F.get_json_object("qualifiers", f"$.{qualifier}") == wanted))
    return entities.join(fit.select("entity_id"), "entity_id", "left_semi")


def optional(column: Column, value: object) -> Column:
    """A condition that holds for all rows where no value is asked for."""
    return F.lit(True) if value is None else F.coalesce(column == F.lit(value), F.lit(False))


def with_member(stories: DataFrame, members: DataFrame, fits: Column) -> DataFrame:
    """Stories with a member that fits."""
    return stories.join(members.where(fits).select("story_id"), "story_id", "left_semi")
