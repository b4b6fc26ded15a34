"""Incremental work: dirty keys, chunks, readiness, catch-up, intervals, job leases, checkpoints, runs and audits of them."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import seconds


def changed_keys(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys that are new, gone or differ in some columns, each with what happened."""
    row = F.xxhash64(*columns)
    a, b = before.select(key, row.alias("_a")), after.select(key, row.alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select(key, "change")


def chunks(dirty: DataFrame, order: str, size: int) -> DataFrame:
    """dirty rows with the number of the chunk in which they are worked off, in an order without ties."""
    from .sync import place

    return place(dirty, order).withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("bigint")).drop("place")


def readiness(status: DataFrame, dirty: DataFrame, source: DataFrame, built: DataFrame) -> DataFrame:
    """One row: whether a projection may be read (its build is done, nothing is dirty, it has as many rows as its source), else why not."""
    one = status.agg(F.max("status").alias("status")).crossJoin(dirty.agg(F.count("*").alias("dirty"))).crossJoin(source.agg(F.count("*").alias("wanted"))).crossJoin(built.agg(F.count("*").alias("have")))
    why = F.when(~F.col("status").eqNullSafe("ready"), "building").when(F.col("dirty") > 0, "dirty").when(F.col("wanted") != F.col("have"), "counts").otherwise("ready")
    return one.select("dirty", "wanted", "have", why.alias("state"))  # one row of each


def publishable(built: DataFrame, keys: DataFrame, key: str, read_at: str, changed: DataFrame) -> DataFrame:
    """Keys that keep a build from being published: not built, or changed after they were read. changed: key, changed_at."""
    last = changed.groupBy(key).agg(F.max("changed_at").alias("changed_at"))
    both = keys.select(key).distinct().join(built.select(key, read_at), key, "left").join(last, key, "left")
    why = F.when(F.col(read_at).isNull(), "unbuilt").when(F.col("changed_at") > F.col(read_at), "changed")
    return both.withColumn("why", why).where("why is not null").select(key, "why")


def pages_needed(listing: DataFrame, known: DataFrame, since: Column, most: int = 20) -> DataFrame:
    """For each source how many pages to read back: to the first page with a known item or one older than since, else as many as it has or most.

    listing: source, page (from 1), item, at; known: source, item.
    """
    marked = listing.join(known.select("source", "item").distinct().withColumn("_known", F.lit(True)), ["source", "item"], "left")
    stops = F.coalesce("_known", F.lit(False)) | (F.col("at") < since)
    by = marked.groupBy("source").agg(F.min(F.when(stops, F.col("page"))).alias("stop"), F.max("page").alias("last"))
    return by.select("source", F.least(F.coalesce("stop", "last"), F.lit(most)).alias("pages"), F.col("stop").isNotNull().alias("met"))


def outages(rounds: DataFrame, key: str, at: str, ok: str, now: Column, least: float) -> DataFrame:
    """Intervals in which rounds fail, from the first failed round to the next good one; short ones are dropped, and one that is still open ends nowhere and counts up to now."""
    w = Window.partitionBy(key).orderBy(at)
    marked = rounds.withColumn("_start", F.when(~F.col(ok) & F.coalesce(F.lag(ok).over(w), F.lit(True)), 1).otherwise(0))
    run = marked.withColumn("_run", F.sum("_start").over(w)).where(F.col("_run") > 0)
    by = run.groupBy(key, "_run").agg(F.min(F.when(~F.col(ok), F.col(at))).alias("started"), F.min(F.when(F.col(ok), F.col(at))).alias("ended"))
    return by.where(seconds(F.coalesce("ended", now)) - seconds("started") >= least).drop("_run")


def period_changes(open_: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Which coverage periods open and which close, so that those open are those wanted."""
    return open_.select(key, F.lit(True).alias("_o")).join(wanted.select(key).distinct().withColumn("_w", F.lit(True)), key, "full").select(key, F.when(F.col("_o").isNull(), "open").when(F.col("_w").isNull(), "close").alias("action")).where("action is not null")


def job_states(log: DataFrame, now: Column, lease: float, attempts: int = 5) -> DataFrame:
    """Each job's state after its log (job, seq, kind, at in seconds): queued, leased, retry (with the time it is due), dead, done.

    Kinds: enqueue, claim, renew, fail, done. A lease that ran out counts as a failure; a failure waits 60 s, twice as long each time, an hour
    at most; after some attempts a job is dead; what follows done does not count.
    """
    ended = log.groupBy("job").agg(F.min(F.when(F.col("kind") == "done", F.col("seq"))).alias("_done"))
    live = log.join(ended, "job").where("_done is null or seq <= _done")
    by = live.groupBy("job").agg(F.max_by(F.struct("kind", "at"), "seq").alias("last"), F.count_if(F.col("kind") == "claim").alias("claims"))
    kind, at = F.col("last.kind"), F.col("last.at")
    held = kind.isin("claim", "renew")
    lapsed = held & (at + lease <= now)
    failed = (kind == "fail") | lapsed
    wait = F.least(F.lit(60) * F.pow(F.lit(2), F.greatest(F.col("claims") - 1, F.lit(0))), F.lit(3600))
    state = F.when(kind == "done", "done").when(failed & (F.col("claims") >= attempts), "dead").when(failed, "retry").when(held, "leased").otherwise("queued")
    due = F.when(state == "retry", F.when(lapsed, at + lease).otherwise(at) + wait)
    return by.select("job", state.alias("state"), "claims", due.cast("bigint").alias("due"))


def next_job(jobs: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The jobs to claim next: ready and due, by priority, then due time, then id."""
    return jobs.where(F.col("state").isin("queued", "retry") & (F.coalesce("due", now) <= now)).orderBy(F.col("priority").desc(), F.coalesce("due", now), "job").limit(limit)


def job_stats(jobs: DataFrame) -> DataFrame:
    """For each kind of job how many are in which state, and which waits longest."""
    return jobs.groupBy("kind").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "leased", "retry", "dead", "done")], F.min_by(F.when(F.col("state") == "queued", F.col("job")), F.when(F.col("state") == "queued", F.struct("at", "job"))).alias("oldest"))


def schedule(stored: DataFrame, configured: DataFrame, now: Column) -> DataFrame:
    """Schedules after a new configuration: next_due stays where the configuration's hash is the same, else it is now. stored: name, config_sha, next_due; configured: name, config."""
    c = configured.select("name", F.sha2("config", 256).alias("sha"))
    both = c.join(stored.select("name", "config_sha", "next_due"), "name", "left")
    return both.select("name", F.col("sha").alias("config_sha"), F.when(F.col("config_sha") == F.col("sha"), F.col("next_due")).otherwise(now).alias("next_due"))


def cursor_state(cursors: DataFrame, epochs: DataFrame) -> DataFrame:
    """Whether each consumer's cursor may go on: its epoch is the dataset's, and it is not beyond the high water. cursors: consumer, dataset, epoch, seq; epochs: dataset, epoch, high_water."""
    e = epochs.select("dataset", F.col("epoch").alias("_e"), "high_water")
    state = F.when(F.col("_e").isNull(), "unknown_dataset").when(F.col("epoch") != F.col("_e"), "epoch_changed").when(F.col("seq") > F.col("high_water"), "high_water_regressed").otherwise("ok")
    return cursors.join(e, "dataset", "left").select("consumer", state.alias("state"))


def clock_state(checkpoints: DataFrame, clocks: DataFrame, age: int = 300, offset_ms: int = 1000) -> DataFrame:
    """Checkpoints (id, high_water, at) with the latest clock check before each, and whether that is fresh and near enough to vouch for it. clocks: at, offset_ms; in seconds."""
    from .temporal import as_of_join

    day = lambda df: df.withColumn("_k", F.floor(F.col("at") / age))
    # a check older than the allowed age counts for nothing, so that of the time bin and the one before is all that is asked
    c = day(clocks.select("at", "offset_ms"))
    c = c.union(c.withColumn("_k", F.col("_k") + 1)).withColumn("checked_at", F.col("at"))
    found = as_of_join(day(checkpoints), c, "_k", "at", "at", ["checked_at", "offset_ms"], "offset_ms")
    state = F.when(F.col("checked_at").isNull() | (F.col("at") - F.col("checked_at") > age), "stale").when(F.abs("offset_ms") > offset_ms, "offset").otherwise("ok")
    return found.select("id", "high_water", state.alias("clock"))


def run_faults(runs: DataFrame) -> DataFrame:
    """Ingest runs whose counts do not add up: accepted and rejected are all raw records, duplicates are among those accepted, nothing is negative."""
    wrong = F.filter(F.array(F.when(F.col("accepted") + F.col("rejected") != F.col("raw"), "partition"), F.when(F.col("duplicate") > F.col("accepted"), "duplicates"), F.when(F.least("raw", "accepted", "rejected", "duplicate") < 0, "negative")), lambda x: x.isNotNull())
    return runs.withColumn("faults", wrong).where(F.size("faults") > 0)


def page_faults(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages of a snapshot that are missing, not in its manifest, or not of the hash there. Both: page, sha256."""
    m = manifest.select("page", F.col("sha256").alias("_m"))
    why = F.when(F.col("sha256").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col("sha256") != F.col("_m"), "hash")
    return pages.select("page", "sha256").join(m, "page", "full").withColumn("fault", why).where("fault is not null").select("page", "fault")


def retry_outcome(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """What publishing each request (key, payload) means: new, a retry of the same payload, or a conflict with another. stored: key, sha."""
    r = requests.select("key", F.sha2("payload", 256).alias("_r"))
    out = F.when(F.col("sha").isNull(), "new").when(F.col("sha") == F.col("_r"), "retry").otherwise("conflict")
    return r.join(stored, "key", "left").select("key", out.alias("outcome"))


def day_list(df: DataFrame, day: str) -> DataFrame:
    """Days with rows, newest first, with how many days lie between each and the one after it in the list."""
    days = df.groupBy(day).agg(F.count("*").alias("n"))
    return days.withColumn("missing", F.coalesce(F.datediff(day, F.lag(day).over(Window.orderBy(day))) - 1, F.lit(0)))  # one row for each day


def growth(sizes: DataFrame, day: str, size: str) -> DataFrame:
    """Sizes by day and what they grew over the day before; a day that is missing gives no growth."""
    w = Window.orderBy(day)  # one row for each day
    before, size_before = F.lag(day).over(w), F.lag(size).over(w)
    return sizes.withColumn("growth", F.when(F.datediff(day, before) == 1, F.col(size) - size_before))


def known_window(rows: DataFrame, key: str, observed: str, accepted: str) -> DataFrame:
    """From when to when each key was seen; it counts as known from the later of its first sighting and its first acceptance."""
    by = rows.groupBy(key).agg(F.min(observed).alias("first_seen"), F.max(observed).alias("last_seen"), F.min(accepted).alias("_a"))
    return by.withColumn("known_from", F.greatest("first_seen", "_a")).drop("_a")


class Cursor:
    """A cursor that only its maker can write: the position with epoch, a hash of the filters and an expiry, under a keyed hash."""

    def __init__(self, secret: bytes):
        self.secret = secret

    def _sign(self, body: bytes) -> bytes:
        return hmac.new(self.secret, body, hashlib.sha256).digest()

    def encode(self, position: list, epoch: str, filters: dict, expires: int) -> str:
        body = json.dumps({"p": position, "e": epoch, "f": hashlib.sha256(json.dumps(filters, sort_keys=True).encode()).hexdigest(), "x": expires}, separators=(",", ":")).encode()
        return base64.urlsafe_b64encode(self._sign(body) + body).decode().rstrip("=")

    def decode(self, text: str, epoch: str, filters: dict, now: int) -> list:
        """The position; ValueError says what is wrong: format, signature, epoch, filters or expired."""
        try:
            raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        except ValueError as error:
            raise ValueError("format") from error
        if len(raw) < 33 or not hmac.compare_digest(raw[:32], self._sign(raw[32:])):
            raise ValueError("signature")
        body = json.loads(raw[32:])
        if body["e"] != epoch:
            raise ValueError("epoch")
        if body["f"] != hashlib.sha256(json.dumps(filters, sort_keys=True).encode()).hexdigest():
            raise ValueError("filters")
        if body["x"] <= now:
            raise ValueError("expired")
        return body["p"]
