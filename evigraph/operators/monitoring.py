"""Service metrics: summaries over trailing windows, histograms, health, status, dashboard.

Performance events: ``ts, component, operation, duration, success``. Accuracy events: ``ts,
query_type, entities_found, confidence, uncertainty, safety_flags``. Error events: ``ts, component,
error_type, error_message``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import ordered as od
from evigraph.functions.numeric import ratio

RESPONSE_EDGES = ([0.5, 1.0, 2.0, 5.0], ["<0.5s", "0.5-1s", "1-2s", "2-5s", ">5s"])
CONFIDENCE_EDGES = ([0.3, 0.5, 0.7, 0.9], ["<0.3", "0.3-0.5", "0.5-0.7", "0.7-0.9", ">0.9"])


def trailing(events: DataFrame, hours: float | None, as_of: Column | None = None, component: str | None = None) -> DataFrame:
    """Events of the last ``hours`` before ``as_of`` (by default the latest event), all when None."""
    out = events if component is None else events.where(F.col("component") == component)
    if hours is None:
        return out
    end = events.agg(F.max("ts")).scalar() if as_of is None else as_of
    return out.where(F.col("ts") >= end - F.make_dt_interval(F.lit(0), F.lit(int(hours)), F.lit(0), F.lit((hours % 1) * 3600.0)))


def performance_summary(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, success and error rate, mean, median, nearest-rank p95/p99, minimum, maximum.

    The order statistics come from distributed rank selection, so one busy component is no bottleneck.
    """
    by = list(by)
    base = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg((~F.col("success")).cast("double")).alias("error_rate"),
        F.avg("duration").alias("avg_response_time"),
        F.min("duration").alias("min_response_time"),
        F.max("duration").alias("max_response_time"),
    )
    ranks = od.exact_ranks(events, by, "duration", {
        "_m0": od.median_low, "_m1": od.median_high,
        "p95_response_time": od.nearest_rank(95), "p99_response_time": od.nearest_rank(99),
    }).withColumn("median_response_time", (F.col("_m0") + F.col("_m1")) / 2).drop("_m0", "_m1", "n")
    return od.same_groups(base, ranks, by) if by else od.attach_scalars(base, ranks)


def accuracy_summary(events: DataFrame) -> DataFrame:
    """Means of confidence, uncertainty and entities, and counts beyond 0.8, below 0.5, above 0.7."""
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return events.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.avg("confidence").alias("avg_confidence"), F.avg("uncertainty").alias("avg_uncertainty"),
        F.avg("entities_found").alias("avg_entities_per_query"),
        count(F.col("confidence") > 0.8).alias("high_confidence_queries"),
        count(F.col("confidence") < 0.5).alias("low_confidence_queries"),
        count(F.col("uncertainty") > 0.7).alias("high_uncertainty_queries"),
    )


def flag_distribution(events: DataFrame) -> DataFrame:
    """Occurrences of each safety flag, repeats included."""
    return events.select(F.explode("safety_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("times"))


def error_summary(errors: DataFrame) -> DataFrame:
    """Error counts in total, by component and by type, from one grouped pass."""
    counted = errors.groupBy("component", "error_type").agg(F.count(F.lit(1)).alias("n"))
    keys = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("key")),
        F.struct(F.lit("component").alias("kind"), F.col("component").alias("key")),
        F.struct(F.lit("type").alias("kind"), F.col("error_type").alias("key")),
    )
    return counted.select("n", F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.sum("n").alias("errors"))


def recent_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    """The latest n errors."""
    return errors.orderBy(F.desc("ts"), "component", "error_type").limit(n)


def component_statistics(events: DataFrame) -> DataFrame:
    """Cumulative statistics per component."""
    return events.groupBy("component").agg(
        F.count(F.lit(1)).alias("total_requests"), F.sum("duration").alias("total_duration"),
        F.sum(F.col("success").cast("bigint")).alias("success_count"),
        F.sum((~F.col("success")).cast("bigint")).alias("error_count"),
        F.avg("duration").alias("avg_response_time"),
        F.avg((~F.col("success")).cast("double")).alias("error_rate"),
    )


def health_of(error_rate: Column) -> Column:
    return F.when(error_rate < 0.01, "healthy").when(error_rate < 0.05, "degraded").otherwise("unhealthy")


def component_health(events: DataFrame) -> DataFrame:
    return component_statistics(events).select(
        "component", health_of(F.col("error_rate")).alias("status"), "error_rate", "avg_response_time", "total_requests"
    )


def status_of(error_rate: Column, confidence: Column, errors: Column) -> Column:
    """System status; without any request it is unknown."""
    c = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(error_rate.isNull(), "unknown")
        .when((error_rate > 0.1) | (c < 0.4) | (errors > 50), "unhealthy")
        .when((error_rate > 0.05) | (c < 0.6) | (errors > 20), "degraded")
        .otherwise("healthy")
    )


def histogram(events: DataFrame, value: str, edges: tuple[list[float], list[str]]) -> DataFrame:
    """Counts per bucket in bucket order, empty buckets included."""
    cuts, labels = edges
    slot = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        slot = F.when(F.col(value) < cuts[i], F.lit(i)).otherwise(slot)
    counts = [F.coalesce(F.sum((slot == i).cast("bigint")), F.lit(0)) for i in range(len(labels))]
    items = F.array(*[F.struct(F.lit(i).alias("bucket_no"), F.lit(x).alias("bucket"), F.col(f"c{i}").alias("n")) for i, x in enumerate(labels)])
    return (
        events.where(F.col(value).isNotNull()).agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)])
        .select(F.explode(items).alias("x")).select("x.*")
    )


def system_overview(performance: DataFrame, accuracy: DataFrame, errors: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Requests of 1 h and 24 h, success, mean time, confidence, errors and status in one row."""
    end = performance.agg(F.max("ts")).scalar() if as_of is None else as_of
    hour = F.expr("INTERVAL 1 HOUR")
    day = trailing(performance, 24, end).withColumn("_h", F.col("ts") >= end - hour)
    perf = day.agg(
        F.coalesce(F.sum(F.col("_h").cast("bigint")), F.lit(0)).alias("requests_1h"),
        F.count(F.lit(1)).alias("requests_24h"),
        F.avg(F.when(F.col("_h"), F.col("success").cast("double"))).alias("success_rate_1h"),
        F.avg(F.when(F.col("_h"), F.col("duration"))).alias("avg_response_time"),
    )
    confidence = trailing(accuracy, 1, end).agg(F.avg("confidence")).scalar()
    n_errors = trailing(errors, 1, end).agg(F.count(F.lit(1))).scalar()
    out = perf.withColumn("avg_confidence", confidence).withColumn("total_errors_1h", n_errors)
    return out.withColumn(
        "system_status", status_of(1 - F.col("success_rate_1h"), F.col("avg_confidence"), F.col("total_errors_1h"))
    )


def hourly_trend(performance: DataFrame) -> DataFrame:
    """Requests and errors per hour."""
    return performance.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum((~F.col("success")).cast("bigint")).alias("errors")
    )


def dashboard(performance: DataFrame, accuracy: DataFrame, errors: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Overview, response and confidence histograms and component health as one nested row.

    Each nested list is bounded: fixed buckets, or one entry per component.
    """
    end = performance.agg(F.max("ts")).scalar() if as_of is None else as_of
    packed = lambda df, order: df.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))).scalar()
    return system_overview(performance, accuracy, errors, end).select(
        F.struct("*").alias("system_overview"),
        packed(histogram(trailing(performance, 1, end), "duration", RESPONSE_EDGES), "bucket_no").alias("response_times"),
        packed(histogram(trailing(accuracy, 1, end), "confidence", CONFIDENCE_EDGES), "bucket_no").alias("confidences"),
        packed(component_health(performance), "component").alias("component_health"),
        packed(flag_distribution(trailing(accuracy, 24, end)), "flag").alias("safety_flags"),
    )


def latency_summary(samples: DataFrame, order_col: str = "seq", skip: int = 10) -> DataFrame:
    """Mean, median, population deviation, extremes and interpolated p95/p99, the first runs left out."""
    cut = samples.orderBy(order_col).limit(skip).agg(F.max(order_col)).scalar() if skip else None
    kept = samples if cut is None else samples.where(F.col(order_col) > cut)
    base = kept.agg(
        F.count(F.lit(1)).alias("samples"), F.avg("duration").alias("mean"), F.stddev_pop("duration").alias("std"),
        F.min("duration").alias("min"), F.max("duration").alias("max"),
    )
    r = od.exact_ranks(kept, [], "duration", {
        "_m0": od.median_low, "_m1": od.median_high, "_a0": od.linear_low(95), "_a1": od.linear_high(95),
        "_b0": od.linear_low(99), "_b1": od.linear_high(99),
    })
    mix = lambda lo, hi, p: F.col(lo) + (F.col(hi) - F.col(lo)) * (
        F.lit(p / 100.0) * (F.col("n") - 1) - F.floor(F.lit(p / 100.0) * (F.col("n") - 1)))
    ranks = r.select(((F.col("_m0") + F.col("_m1")) / 2).alias("median"), mix("_a0", "_a1", 95).alias("p95"), mix("_b0", "_b1", 99).alias("p99"))
    return od.attach_scalars(base, ranks)


def throughput(batches: DataFrame) -> DataFrame:
    """Samples per second and mean time per sample over ``batch_size, duration`` rows."""
    return batches.agg(
        ratio(F.sum("batch_size"), F.sum("duration")).alias("samples_per_second"),
        ratio(F.sum("duration"), F.sum("batch_size")).alias("seconds_per_sample"),
    )


# Alert rules as data: a predicate over the combined hourly statistics.
REFIRE_SECONDS = 3600
ALERT_RULES = [
    ("high_error_rate", "error_rate > 0.1", "warning", "More than one request in ten failed"),
    ("slow_response_time", "avg_response_time > 5.0", "warning", "Requests take over five seconds on average"),
    ("low_confidence_predictions", "avg_confidence < 0.5", "warning", "Mean confidence fell below one half"),
    ("high_uncertainty", "avg_uncertainty > 0.8", "critical", "Mean uncertainty rose above four fifths"),
]


_PREDICATE_WORDS = {"and", "or", "not", "is", "null", "between", "in", "true", "false"}


def alert_candidates(stats: DataFrame, rules: Sequence[tuple[str, str, str, str]] = ALERT_RULES) -> DataFrame:
    """Rule hits per statistics row: ``ts, name, severity, message``. A missing statistic never fires."""
    words = {w for _, cond, _, _ in rules for w in re.findall(r"[A-Za-z_]\w*", cond) if w.lower() not in _PREDICATE_WORDS}
    stats = stats.withColumns({w: F.lit(None).cast("double") for w in sorted(words - set(stats.columns))})
    hits = F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(m).alias("message")))
        for n, cond, s, m in rules
    ])
    return stats.select("ts", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("a")).select("ts", "a.*")


def hourly_stats(performance: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Combined statistics per hour, the rows that alert rules look at; ``ts`` is the hour's end."""
    end = F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")
    p = performance.groupBy(end.alias("ts")).agg(
        F.avg((~F.col("success")).cast("double")).alias("error_rate"), F.avg("duration").alias("avg_response_time"))
    a = accuracy.groupBy(end.alias("ts")).agg(
        F.avg("confidence").alias("avg_confidence"), F.avg("uncertainty").alias("avg_uncertainty"))
    return p.join(a, "ts", "full")


def trailing_stats(performance: DataFrame, accuracy: DataFrame, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Combined statistics of the trailing ``width`` at every check; checks are ``step`` apart, ``ts`` is their time.

    Means per overlapping window, combined before the shuffle, so a busy minute is no larger task than a quiet one.
    A check without events has no row; a kind of event that is missing has null statistics.
    """
    end = lambda df: df.groupBy(F.window("ts", width, step).alias("_w"))
    p = end(performance).agg(
        F.avg((~F.col("success")).cast("double")).alias("error_rate"), F.avg("duration").alias("avg_response_time"))
    a = end(accuracy).agg(F.avg("confidence").alias("avg_confidence"), F.avg("uncertainty").alias("avg_uncertainty"))
    at = lambda df: df.withColumn("ts", F.col("_w.end")).drop("_w")
    return at(p).join(at(a), "ts", "full")


def gate_alerts(hits: DataFrame, seconds: float = REFIRE_SECONDS) -> DataFrame:
    """Hits that fire: the first of a rule, then each that is more than ``seconds`` after the last that fired.

    Two levels: a hit that follows the one before it by more than the limit always fires, so these hits cut a
    rule's history in stretches that are folded apart. Input is one hit per rule and check: its size goes with the
    time covered, not with the events. Hits at the same time: one fires. Hits without a time never fire.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    limit = F.lit(int(seconds * 1_000_000))
    order = Window.partitionBy("name").orderBy("ts")
    before = F.lag(micros).over(order)
    cut = hits.where(F.col("ts").isNotNull()).withColumn("_new", (before.isNull() | (micros - before > limit)).cast("int"))
    item = F.struct(micros.alias("at"), "severity", "message", "ts")
    stretches = cut.withColumn("_part", F.sum("_new").over(order)).groupBy("name", "_part").agg(F.array_sort(F.collect_list(item)).alias("_hits"))
    none = F.filter("_hits", lambda h: F.lit(False))
    fired = F.aggregate("_hits", none, lambda kept, h: F.when(
        (F.size(kept) == 0) | (h["at"] - F.try_element_at(kept, F.lit(-1))["at"] > limit), F.array_append(kept, h)).otherwise(kept))
    return stretches.select("name", F.explode(fired).alias("_h")).select("name", "_h.severity", "_h.message", "_h.ts")


def alerts(performance: DataFrame, accuracy: DataFrame, rules: Sequence[tuple[str, str, str, str]] = ALERT_RULES,
           seconds: float = REFIRE_SECONDS, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Alerts over recorded events: rules on trailing statistics at every check, behind the re-fire limit."""
    return gate_alerts(alert_candidates(trailing_stats(performance, accuracy, width, step), rules), seconds)
