"""Order statistics and positions for groups of any size.

A window over a group puts the whole group into one task. The helpers here give the same exact
answers while a hot group stays spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import cut_lineage

# Distinct values of a group that may meet in one window of exact_ranks.
RANK_ROWS = 100_000
PARTS = 100


def exact_ranks(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    targets: dict[str, Callable[[Column], Column]],
    accuracy: int = 10000,
    limit: int | None = None,
) -> DataFrame:
    """Values at given zero-based positions of each group's ascending order, exactly.

    ``targets`` maps an output column to a function from the group size to the wanted position.
    Pass one is a mergeable sketch (rank error at most 1/accuracy) that brackets every position;
    pass two counts distinct values inside the brackets, everything below a bracket collapsing to
    one row before the shuffle. While a bracket holds more than ``limit`` distinct values (``RANK_ROWS``;
    1,000 at least), it is cut into ``PARTS`` parts and the part with the position goes on as the
    bracket, so no window sees more than ``limit`` rows however large a group is. Each round reads a
    written table about a hundredth of the one before; the driver sees one number a round.
    Result: group columns, ``n`` and one column per target.
    """
    limit = max(RANK_ROWS if limit is None else limit, 1_000)
    g = list(group_cols)
    names = list(targets)
    rows = df.where(F.col(value_col).isNotNull()).select(*g, F.col(value_col).alias("_v"))
    steps = 1000
    probes = [i / steps for i in range(steps + 1)]
    sketch = rows.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_v", probes, accuracy).alias("_cuts"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    slack = 2.0 / accuracy

    def bracket(name: str) -> Column:
        pos = targets[name](F.col("n")).cast("bigint")
        q = pos / F.col("n")
        low = F.floor((q - slack) * steps).cast("int")
        high = F.ceil(((pos + 1) / F.col("n") + slack) * steps).cast("int")
        return F.struct(
            F.lit(name).alias("target"),
            pos.alias("pos"),
            F.when(low <= 0, F.col("_lo")).otherwise(F.try_element_at("_cuts", low + 1)).alias("low"),
            F.when(high >= steps, F.col("_hi")).otherwise(F.try_element_at("_cuts", high + 1)).alias("high"),
        )

    bounds = sketch.select(*g, "n", F.array(*[bracket(t) for t in names]).alias("_b"))
    joined = same_groups(rows, bounds, g) if g else _with_single_row(rows, bounds, ["n", "_b"])
    hits = (
        joined.select(*g, "n", "_v", F.explode("_b").alias("_t"))
        .where(F.col("_v") <= F.col("_t.high"))
        .select(
            *g, "n",
            F.col("_t.target").alias("_target"), F.col("_t.pos").alias("_pos"),
            F.when(F.col("_v") >= F.col("_t.low"), F.col("_v")).alias("_key"),
        )
        .groupBy(*g, "n", "_target", "_pos", "_key").agg(F.count(F.lit(1)).alias("_c"))
    )
    hits = _narrowed(hits, g, accuracy, limit)
    run = Window.partitionBy(*g, "_target").orderBy(F.col("_key").asc_nulls_first())
    picked = hits.withColumn("_cum", F.sum("_c").over(run)).where(
        (F.col("_cum") > F.col("_pos")) & (F.col("_cum") - F.col("_c") <= F.col("_pos"))
    )
    return picked.groupBy(*g).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_target") == t, F.col("_key"))).alias(t) for t in names],
    )


def _narrowed(hits: DataFrame, g: Sequence[str], accuracy: int, limit: int) -> DataFrame:
    """Brackets with at most ``limit`` distinct values each; a row without a key counts what lies below."""
    keys = [*g, "_target"]
    probes = [i / PARTS for i in range(1, PARTS)]
    hits = cut_lineage(hits)
    while (hits.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > limit:
        cuts = hits.where(F.col("_key").isNotNull()).groupBy(*keys).agg(F.percentile_approx("_key", probes, accuracy).alias("_cuts"))
        part = F.when(F.col("_key").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_key"))))
        parted = cut_lineage(same_groups(hits, cuts, keys).withColumn("_part", part).drop("_cuts"))
        # at most PARTS + 1 rows of a bracket meet here
        upto = Window.partitionBy(*keys).orderBy("_part")
        held = (
            parted.groupBy(*keys, "n", "_pos", "_part").agg(F.sum("_c").alias("_c"))
            .withColumn("_cum", F.sum("_c").over(upto))
            .where((F.col("_cum") > F.col("_pos")) & (F.col("_cum") - F.col("_c") <= F.col("_pos")))
        )
        inside = same_groups(parted, held.select(*keys, "_part"), [*keys, "_part"]).select(hits.columns)
        below = held.withColumn("_key", F.lit(None).cast(hits.schema["_key"].dataType)).withColumn("_c", F.col("_cum") - F.col("_c"))
        hits = cut_lineage(inside.unionByName(below.select(hits.columns)))
    return hits


def _with_single_row(rows: DataFrame, one_row: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Attach the columns of a one-row frame as an uncorrelated scalar subquery (no join, no shuffle)."""
    packed = one_row.select(F.struct(*cols).alias("_s")).scalar()
    return rows.withColumn("_s", packed).select("*", *[F.col(f"_s.{c}").alias(c) for c in cols]).drop("_s")


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add every column of an aggregated one-row frame to all rows of ``df``."""
    return _with_single_row(df, one_row, one_row.columns)


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """Position of the nearest-rank percentile: min(int(p/100 * n), n - 1)."""
    return lambda n: F.least(F.floor(F.lit(p / 100.0) * n), n - 1)


def same_groups(left: DataFrame, right: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Inner join on group columns in which null is a group like any other."""
    named = right.withColumnsRenamed({c: f"_same_{c}" for c in group_cols})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in group_cols])
    return left.join(named, on).drop(*[f"_same_{c}" for c in group_cols])


def median_low(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def median_high(n: Column) -> Column:
    return F.floor(n / 2)


def linear_low(p: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(F.lit(p / 100.0) * (n - 1))


def linear_high(p: float) -> Callable[[Column], Column]:
    return lambda n: F.least(F.floor(F.lit(p / 100.0) * (n - 1)) + 1, n - 1)


def dense_index(df: DataFrame, order_cols: Sequence[str | Column], index_col: str, start: int = 0) -> DataFrame:
    """Consecutive positions in a total order, without a single-task window.

    The rows are range-sorted and frozen once; a row's position is its offset inside its partition
    plus the sizes of the partitions before it (one small row per partition).
    """
    placed = cut_lineage(
        df.orderBy(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright("_mid", 33))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the number of partitions, whatever the data size
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(index_col, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start))
        .drop("_pid", "_mid", "_off")
    )


def spread_running(
    df: DataFrame,
    group_cols: Sequence[str],
    bucket: Column,
    order_cols: Sequence[str | Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Running sum (inclusive) inside each group, in two levels.

    ``bucket`` must be monotone in the order; a window only ever holds one (group, bucket), plus
    one summary row per bucket of a group.
    """
    g = list(group_cols)
    staged = df.withColumn("_bk", bucket).withColumn("_val", value)
    sums = staged.groupBy(*g, "_bk").agg(F.sum("_val").alias("_sum"))
    earlier = Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*g, "_bk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*g, "_bk").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.join(offsets, [*g, "_bk"])
        .withColumn(out, F.col("_off") + F.sum("_val").over(inside))
        .drop("_bk", "_val", "_off")
    )


def spread_row_number(
    df: DataFrame, group_cols: Sequence[str], bucket: Column, order_cols: Sequence[str | Column], out: str
) -> DataFrame:
    """``row_number()`` (from 1) for groups of any size; see :func:`spread_running`."""
    return spread_running(df, group_cols, bucket, order_cols, F.lit(1).cast("bigint"), out)


def top_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group. Spark prunes to k rows per group before the shuffle."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bags(rows: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Keys with the same set of items as one bag: ``key, bag_id`` and ``bag_id, item``.

    What depends on the items alone is worked out once a bag. A null item is no item, a null key is a key; a key
    without an item has no bag.
    """
    sets = cut_lineage(rows.where(F.col(item).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("_bag")))
    # written, so that a number stays with its bag
    numbered = cut_lineage(sets.select("_bag").distinct().withColumn("bag_id", F.monotonically_increasing_id()))
    members = cut_lineage(sets.join(numbered, "_bag").select(key, "bag_id"))
    return members, numbered.select("bag_id", F.explode("_bag").alias(item))
