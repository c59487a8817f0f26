"""The crawl frontier: priorities, seen requests, waves, statistics, retries and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.session import materialize
from pagewright.sources.responses import merged_meta

#: Statuses that mean a block (fixed values).
BLOCKED = (401, 403, 407, 429, 444, 500, 502, 503, 504)


def with_fingerprint(requests: DataFrame) -> DataFrame:
    """Requests with the fingerprint of the default options; null for a broken URL."""
    return requests.withColumn("fp", urls.request_fingerprint(F.col("url"), F.col("method"), F.col("sid"), F.col("body").cast("string")))


def accepted(requests: DataFrame, order: str, seen: DataFrame | None = None) -> DataFrame:
    """Requests that a scheduler takes: forced ones, and the first of each fingerprint (``fp``) that
    isn't seen. Forced requests leave no mark, so a later normal one is still new."""
    free = requests.where(~F.coalesce("dont_filter", F.lit(False)) & F.col("fp").isNotNull())
    if seen is not None:
        free = free.join(seen.select("fp").distinct(), "fp", "left_anti")
    # the first of a fingerprint by aggregation, which runs before the shuffle, so no key is hot
    firsts = free.groupBy("fp").agg(F.min(order).alias(order)).select(order)
    forced = requests.where(F.coalesce("dont_filter", F.lit(False)))
    return forced.unionByName(free.join(firsts, order, "left_semi").select(*requests.columns))


def _ranged(rows: DataFrame, partition: str | None, keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows in range-partitioned order with ``__part`` and ``__row`` (their place in it), written once; and
    the runs (partition value, part) with how many rows they have and where in the part they begin.

    A partition value, however hot, is cut by the ranges, and there are no more runs than ranges and
    values together.
    """
    by = ([F.asc(partition)] if partition else []) + keys
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    written = materialize(sorted_.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id() % (1 << 33)}), "frontier")
    value = F.col(partition) if partition else F.lit(0)
    written = written.withColumn("__value", value)
    runs = written.groupBy("__value", "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    return written, runs


def _with_runs(written: DataFrame, runs: DataFrame) -> DataFrame:
    right = runs.withColumnsRenamed({"__value": "__value2", "__part": "__part2"})
    return written.join(right, F.col("__value").eqNullSafe(F.col("__value2")) & (F.col("__part") == F.col("__part2")))


def dequeue_order(requests: DataFrame, order: str, partition: str | None = None) -> DataFrame:
    """With ``place``: by priority from the highest, then in order of arrival, within a partition or
    globally.

    The order is a range-partitioned sort; rows are numbered by the counts of the ranges before theirs, so
    no task sees all rows of a partition, whatever part of the table it is.
    """
    written, runs = _ranged(requests, partition, [F.desc("priority"), F.asc(order)])
    before = F.sum("__n").over(Window.partitionBy("__value").orderBy("__part")) - F.col("__n")
    out = _with_runs(written, runs.withColumn("__before", before))
    return out.select(*requests.columns, (F.col("__before") + F.col("__row") - F.col("__first") + 1).alias("place"))


def is_blocked(status: Column) -> Column:
    return status.isin(*BLOCKED)


def retries(responses: DataFrame, limit: int = 3) -> DataFrame:
    """Blocked responses' requests to be sent again: forced, one priority lower, one retry more, as
    long as the limit allows (0 means 3, negative none)."""
    limit = 3 if limit == 0 else max(limit, 0)
    again = responses.where(is_blocked(F.col("status")) & (F.coalesce("retry_count", F.lit(0)) < limit))
    for c in ("proxy", "proxies"):  # the next try takes another one
        if c in again.columns:
            again = again.withColumn(c, F.lit(None).cast(again.schema[c].dataType))
    return again.withColumns({"retry_count": F.coalesce("retry_count", F.lit(0)) + 1, "priority": F.col("priority") - 1, "dont_filter": F.lit(True)})


def crawl(
    seeds: DataFrame,
    pages: DataFrame,
    follow: Callable[[DataFrame], DataFrame],
    depth: int,
    domains: list[str] | None = None,
    policies: DataFrame | None = None,
    user_agent: str = "*",
    host_limit: int = 0,
    items: Callable[[DataFrame], DataFrame] | None = None,
    target: str = "",
) -> DataFrame:
    """Waves of a crawl over stored pages: (url, wave), each URL once, at its first wave.

    ``seeds`` has url; ``pages`` (page_id, url, html, perhaps status) is the web; ``follow`` gives (page_id,
    url) of the links of pages, and perhaps their priority. Each wave joins the frontier with the pages,
    leaves blocked ones out, follows, drops offsite links and those that robots ``policies`` (origin, status,
    body) forbid, anti-joins what was seen, and takes the first ``host_limit`` of each host by priority (0
    takes all). ``items`` makes rows of the pages of a wave; they are appended to ``target``, a parquet
    folder. A wave is written to the shared folder, which cuts the lineage.
    """
    from pagewright.operators.links import allowed
    from pagewright.operators.robots import check

    found = [materialize(seeds.select(urls.canonical_request(F.col("url")).alias("url")).where("url is not null").distinct().withColumn("wave", F.lit(0)), "wave")]
    web = materialize(pages.withColumn("key", urls.canonical_request(F.trim("url"))).where("key is not null"), "web")  # keyed once, not in every wave
    if "status" in pages.columns:
        web = web.where(~F.coalesce(is_blocked(F.col("status")), F.lit(False)))
    for wave in range(depth + 1):
        here = web.join(found[-1].select(F.col("url").alias("key")), "key", "left_semi").drop("key")
        if items is not None and target:
            items(here).withColumn("wave", F.lit(wave)).write.mode("append").parquet(target)
        if wave == depth:
            break
        links = follow(here)
        rank = F.max("priority") if "priority" in links.columns else F.lit(0)
        new = links.where(allowed(F.col("url"), domains or [])).groupBy("url").agg(rank.alias("priority"))
        new = new.join(reduce(DataFrame.unionByName, found).select("url"), "url", "left_anti")
        if policies is not None:
            new = check(new, policies, user_agent).where("allowed").select("url", "priority")
        new = limit_per_host(new, host_limit, "url").select("url")
        found.append(materialize(new.withColumn("wave", F.lit(wave + 1)), "wave"))
        if found[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def crawl_stats(log: DataFrame) -> DataFrame:
    """(key, name, value): counters and maps of a crawl log (outcome, status, host, sid, bytes, items).

    Outcomes are ok, blocked, failed, skipped, offsite, robots and dropped; only ok and blocked ones
    count as requests, and only they have a status, a session and bytes.
    """
    sent = F.col("outcome").isin("ok", "blocked")
    total = log.agg(
        F.count(F.when(sent, 1)).alias("requests"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("blocked", "failed", "skipped", "offsite", "robots", "dropped")],
        F.coalesce(F.sum(F.when(sent, F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
    names = total.columns
    counters = total.select(F.explode(F.array(*[F.struct(F.lit("").alias("key"), F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names])).alias("x")).select("x.*")
    maps = [("status", F.count("*")), ("sid", F.count("*")), ("host", F.sum("bytes"))]
    each = [log.where(sent & F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("name")).agg(a.cast("long").alias("value")).select(F.lit(c).alias("key"), "name", "value") for c, a in maps]
    return reduce(DataFrame.unionByName, [counters, *each])


def crawl_times(log: DataFrame, key: str, at: str) -> DataFrame:
    """(key, started_at, ended_at, elapsed): first and last time of each crawl, and the seconds between."""
    out = log.where(F.col(at).isNotNull()).groupBy(key).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
    return out.withColumn("elapsed", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)


def save_checkpoint(pending: DataFrame, seen: DataFrame, path: str) -> None:
    """Pending requests and seen fingerprints, written whole under a new name; only then the name of the
    current one is replaced in one step, so a reader never meets half a checkpoint. Older ones stay."""
    spark = pending.sparkSession
    name = uuid.uuid4().hex
    pending.write.parquet(f"{path}/{name}/pending")
    seen.select("fp").distinct().write.parquet(f"{path}/{name}/seen")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, fs = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    fresh, current = files.Path(f"{path}/{name}/name"), files.Path(f"{path}/current")
    out = fs.create(fresh, True)
    out.writeBytes(name)
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    overwrite[0] = files.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, current, overwrite)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pending, seen) as saved last; the fingerprints of pending normal requests count as seen. Without a
    checkpoint it is an error."""
    name = spark.read.text(f"{path}/current").first()[0]
    pending, seen = spark.read.parquet(f"{path}/{name}/pending"), spark.read.parquet(f"{path}/{name}/seen")
    marks = pending.where(~F.coalesce("dont_filter", F.lit(False)) & F.col("fp").isNotNull()).select("fp")
    return pending, seen.select("fp").unionByName(marks).distinct()


def route(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests with the session they go to: theirs, else the default one (``sessions``: sid,
    is_default); ``error`` tells of an unknown one."""
    default = sessions.where("is_default").agg(F.min("sid").alias("__default"))
    out = requests.join(F.broadcast(default))  # default is one row
    sid = F.coalesce(F.nullif(F.trim("sid"), F.lit("")), "__default")
    out = out.withColumn("session", sid).drop("__default").join(sessions.select(F.col("sid").alias("session"), F.lit(True).alias("__known")).distinct(), "session", "left")
    return out.withColumn("error", F.when(F.col("__known").isNull(), F.concat(F.lit("unknown session "), F.coalesce("session", F.lit(""))))).drop("__known")


def rotate(rows: DataFrame, order: str, values: list[str], partition: str | None = None) -> DataFrame:
    """With ``choice``: the values in turn, in the given order. No values is an error."""
    if not values:
        raise ValueError("nothing to rotate")
    ranked = dequeue_order(rows.withColumn("priority", F.lit(0)), order, partition) if "priority" not in rows.columns else dequeue_order(rows.withColumnRenamed("priority", "__p").withColumn("priority", F.lit(0)), order, partition)
    out = ranked.withColumn("choice", F.element_at(F.array(*map(F.lit, values)), ((F.col("place") - 1) % len(values) + 1).cast("int"))).drop("place", "priority")
    return out.withColumnRenamed("__p", "priority") if "__p" in out.columns else out


def last_n(rows: DataFrame, partition: str, order: str, n: int = 5) -> DataFrame:
    """The n latest rows of each partition, ``ago`` 0 for the latest."""
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    return rows.withColumn("ago", F.row_number().over(w) - 1).where(F.col("ago") < n)


def limit_per_host(requests: DataFrame, limit: int, order: str) -> DataFrame:
    """The first requests of each host in scheduling order, as many as the limit; 0 or less has none."""
    if limit <= 0:
        return requests
    w = Window.partitionBy(urls.host(F.col("url"))).orderBy(F.desc("priority"), order)
    return requests.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def start_times(requests: DataFrame, order: str, delay: Column) -> DataFrame:
    """With ``starts_at``: seconds after which each request of a host starts if every one waits its
    delay behind the one before (a simulated clock; nothing sleeps). Sums run inside the ranges of a sort
    and are moved by the sums of the ranges before, so a hot host is spread over tasks."""
    rows = requests.withColumns({"__d": delay, "__host": urls.host(F.col("url"))})
    written, _ = _ranged(rows, "__host", [F.desc("priority"), F.asc(order)])
    sums = written.groupBy("__value", "__part").agg(F.sum("__d").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("__value").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = F.coalesce(F.sum("__d").over(Window.partitionBy("__value", "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = _with_runs(written.withColumn("__own", own), sums.withColumn("__before", before))
    return out.select(*requests.columns, (F.col("__before") + F.col("__own")).alias("starts_at"))


def follow_ups(found: DataFrame, origin: DataFrame, referer: bool = True) -> DataFrame:
    """Requests for links (page_id, url) of the requests that led to them (page_id, and a request's
    columns with its url as request_url): method, body, headers, session and priority are inherited,
    forcing isn't. Where both sides have a ``meta`` map, they are merged and the link's values count."""
    keep = [c for c in origin.columns if c not in ("page_id", "url", "request_url", "dont_filter", "headers")]
    own_meta = "meta" in found.columns and "meta" in origin.columns
    if own_meta:
        found = found.withColumnRenamed("meta", "__meta")
    out = found.join(origin, "page_id")
    if own_meta:
        empty = F.create_map().cast("map<string,string>")
        out = out.withColumn("meta", merged_meta(F.coalesce("meta", empty), F.coalesce("__meta", empty)))
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,array<string>>"))
    if referer:
        headers = F.map_concat(F.map_filter(headers, lambda k, v: F.lower(k) != "referer"), F.create_map(F.lit("Referer"), F.array("request_url")))
    return out.select("page_id", found["url"].alias("url"), *keep, headers.alias("headers"), F.lit(False).alias("dont_filter"))


def backoff(attempt: Column, delay: float, attempts: int = 3) -> Column:
    """Seconds to wait before an attempt (from 1): none before the first, null beyond the last."""
    return F.when(attempt > attempts, F.lit(None).cast("double")).when(attempt <= 1, 0.0).otherwise(delay * F.pow(F.lit(2.0), attempt - 2))


def redirect_history(start: DataFrame, hops: DataFrame, limit: int = 30) -> DataFrame:
    """(url, final_url, history, error): chains of redirects (source, target), followed up to a limit.
    Each hop is one join of the chains that still move, so work shrinks with them. A chain that moves on
    behind the limit, or that comes back to an address it has left, has an error and ends there."""
    moving = start.select("url", F.col("url").alias("final_url"), F.array().cast("array<string>").alias("history"))
    done = None
    for _ in range(limit):
        step = materialize(moving.join(hops.withColumnRenamed("source", "final_url").dropDuplicates(["final_url"]), "final_url", "left"), "hops")
        loop = F.array_contains("history", F.col("target")) | (F.col("target") == F.col("final_url"))
        error = F.when(F.coalesce(loop, F.lit(False)), "redirect loop")
        still = step.where(F.col("target").isNull() | loop).select("url", "final_url", "history", error.alias("error"))
        done = still if done is None else done.unionByName(still)
        moving = step.where(F.col("target").isNotNull() & ~loop).select("url", F.col("target").alias("final_url"), F.concat("history", F.array("final_url")).alias("history"))
        if moving.isEmpty():
            return done
    last = moving.join(hops.select(F.col("source").alias("final_url"), F.lit(True).alias("more")).distinct(), "final_url", "left")
    return done.unionByName(last.select("url", "final_url", "history", F.when(F.col("more"), f"stopped after {limit} redirects").alias("error")))
