"""Reports on collection: source metrics, fetch outcomes, health, counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import half_up


def stats_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


def source_latency(log: DataFrame) -> DataFrame:
    """Of log rows (source, seq, seconds, ok): mean of the last 5, success rate, priority and band of each source."""
    order = Window.partitionBy("source").orderBy(F.desc("seq"))
    recent = log.withColumn("n", F.row_number().over(order)).where("n <= 20")
    per = recent.groupBy("source").agg(F.avg(F.when(F.col("n") <= 5, F.col("seconds"))).alias("mean"), F.sum(F.when((F.col("n") <= 10) & F.col("ok"), 1).otherwise(0)).alias("good"), F.least(F.count("*"), F.lit(10)).alias("tries"))
    rate = F.col("good") / F.col("tries")
    speed = F.when(F.col("mean") < 2, 100.0).when(F.col("mean") > 10, 0.0).otherwise(100 - 12.5 * (F.col("mean") - 2))
    priority = (100 - (70 * rate + 0.3 * speed)).cast("int")
    out = per.select("source", half_up(F.col("mean"), 2).alias("mean_seconds"), half_up(rate, 2).alias("success_rate"), priority.alias("priority"))
    return out.withColumn("band", F.when(F.col("priority") < 30, 1).when(F.col("priority") < 60, 2).otherwise(3))


def fetch_summary(outcomes: DataFrame) -> DataFrame:
    """Of rows (source, outcome): totals, and ok, partial or degraded."""
    n = lambda *names: F.sum(F.when(F.col("outcome").isin(*names), 1).otherwise(0))
    one = outcomes.agg(F.count("*").alias("total"), n("success", "partial", "unchanged").alias("success"), n("unchanged").alias("unchanged"), n("error").alias("failed"))
    return one.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("success") > 0, "partial").otherwise("degraded"))


def health(last: DataFrame, now: str) -> DataFrame:
    """Of rows (source, last_ok): unknown, down after 24 hours, degraded after 4, else ok."""
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_ok")) / 3600
    return last.select("source", F.when(F.col("last_ok").isNull(), "unknown").when(hours > 24, "down").when(hours > 4, "degraded").otherwise("ok").alias("status"))


def bloom_size(capacity: int = 100_000, error: float = 0.001) -> tuple[int, int]:
    """Bits and hash functions of a filter, for reports: joins here are exact and need none."""
    bits = int(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, int(bits / capacity * math.log(2)))


def run_rows(outcomes: DataFrame) -> DataFrame:
    """The log's row for each run of rows (run, source, seconds, items, error): items, new items, milliseconds, errors as JSON.

    Every item counts as new, as in the log that this replaces. Append the rows to the log.
    """
    errors = F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("source", "error")))), lambda x: F.concat_ws(": ", x["source"], x["error"])))
    per = outcomes.groupBy("run").agg(F.sum("items").alias("total_items"), F.sum(F.round(F.col("seconds") * 1000)).cast("long").alias("duration_ms"), errors.alias("errors"))
    return per.select("run", "total_items", F.col("total_items").alias("new_items"), "duration_ms", "errors")


def latest_run(log: DataFrame) -> DataFrame:
    """The last row of the log."""
    return log.orderBy(F.desc("run")).limit(1)


def source_state(log: DataFrame) -> DataFrame:
    """Of rows (source, seq, seconds, items, error): each source's cursor, fetches, errors, last count and error, and mean milliseconds."""
    ok = F.col("error").isNull()
    per = log.groupBy("source").agg(
        F.max("seq").alias("cursor"), F.sum(ok.cast("int")).alias("fetches"), F.sum((~ok).cast("int")).alias("errors"), F.max_by("items", F.when(ok, F.col("seq"))).alias("last_count"),
        F.max_by("error", F.when(~ok, F.col("seq"))).alias("last_error"), F.avg(F.when(ok, F.floor(F.col("seconds") * 1000))).alias("mean"),
    )
    return per.select("source", "cursor", "fetches", "errors", "last_count", "last_error", half_up(F.col("mean"), 1).alias("mean_ms"))


def reused(fetches: DataFrame, block: int = 100_000) -> DataFrame:
    """Of rows (source, seq, changed, items): the items that each source shows after every fetch; one that has not changed shows the last ones again.

    A source's fetches are looked at in blocks of `block` numbers, which take over the last change of those before, so
    that one that has most of the rows is spread.
    """
    rows = fetches.withColumn("_block", F.floor(F.col("seq") / block))
    change = F.when(F.col("changed"), F.struct("items"))
    here = Window.partitionBy("source", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("source", "_block").agg(F.max_by(change, F.when(F.col("changed"), F.col("seq"))).alias("_end"))
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.withColumn("_taken", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    known = rows.withColumn("_here", F.last(change, ignorenulls=True).over(here)).join(taken, ["source", "_block"])
    last = F.coalesce("_here", "_taken")
    return known.select("source", "seq", F.coalesce(last["items"], F.lit(0)).alias("items"), (~F.col("changed") & last.isNotNull()).alias("used_cache"))


def _metrics(log: DataFrame, now: float) -> DataFrame:
    """Of rows (source, seq, at, seconds, ok, limited): mean of the last 5, success rate, failures in a row, rate limits and seconds since the last.

    Rows later than `now` do not count yet. Sums are made before a source's rows meet; of its last five each task sends
    five at most.
    """
    log = log.where(F.col("at") <= now)
    last = log.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("seq")))).where("n <= 5").groupBy("source").agg(F.avg("seconds").alias("mean"))
    per = log.groupBy("source").agg(
        F.sum(F.col("ok").cast("int")).alias("good"), F.count("*").alias("tries"), F.max(F.when(F.col("ok"), F.col("seq"))).alias("good_at"),
        F.sum(F.col("limited").cast("int")).alias("limits"), F.max(F.when(F.col("limited"), F.col("at"))).alias("limited_at"),
    )
    failed = log.where(~F.col("ok")).join(per.select("source", "good_at"), "source").where(F.col("good_at").isNull() | (F.col("seq") > F.col("good_at")))
    per = per.join(last, "source").join(failed.groupBy("source").agg(F.count("*").alias("failures")), "source", "left")
    rate = F.col("good") / F.least("tries", F.lit(10))
    return per.select("source", "mean", rate.alias("rate"), F.coalesce("failures", F.lit(0)).alias("failures"), "limits", (F.lit(now) - F.col("limited_at")).alias("since"))


def delays(log: DataFrame, now: float) -> DataFrame:
    """source and the seconds to wait before its next request: more after failures in a row, rate limits in the last minute and slow answers."""
    m = _metrics(log, now)
    wait = 0.3 + F.least(0.5 * F.col("failures"), F.lit(3.0)) + F.when(F.col("since") < 60, F.greatest(F.lit(0.0), 2 - F.col("since") / 30)).otherwise(0.0) + F.when(F.col("mean") > 5, 0.5).otherwise(0.0)
    return m.select("source", half_up(wait, 4).alias("delay"))


def advice(log: DataFrame, now: float) -> DataFrame:
    """source, advice, value: one row for each thing that should change. The rate is of at most ten tries, so it can pass 1."""
    m = _metrics(log, now)
    found = F.array_compact(
        F.array(
            F.when(F.col("rate") < 0.5, F.struct(F.lit("often fails").alias("advice"), half_up(F.col("rate"), 3).alias("value"))),
            F.when(F.col("limits") > 3, F.struct(F.lit("often limited").alias("advice"), F.col("limits").cast("double").alias("value"))),
            F.when(F.col("mean") > 8, F.struct(F.lit("slow").alias("advice"), half_up(F.col("mean"), 1).alias("value"))),
        )
    )
    return m.select("source", F.inline(found))
