"""Best rows per group, and positions within groups, without one task per hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.session import materialize

#: Groups of up to so many rows are sorted by one task.
GROUP_ROWS = 1_000_000
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
    spread_by: str | None = None,
    spread: int = 32,
) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, numbered from 1.

    Spark cuts every map task's share of a group to ``k`` rows before the shuffle
    (``WindowGroupLimit``); for a ``k`` above the session's threshold of it, the threshold is raised to ``k``. ``spread_by`` names a column
    whose hash first splits each group into ``spread`` parts, for groups that may hold a large
    share of all rows: no task then sorts more than one part of a group, and the last step
    merges ``spread * k`` rows at most. ``order`` must be total for a repeatable result.
    """
    conf = df.sparkSession.conf
    if k > int(conf.get(GROUP_LIMIT_SETTING)):
        conf.set(GROUP_LIMIT_SETTING, str(k))
    if spread_by is not None:
        part = F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("int")
        by_part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_place", F.row_number().over(by_part))
            .where(F.col("_place") <= k)
            .drop("_part", "_place")
        )
    by_group = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by_group)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], spread_by: str | None = None) -> DataFrame:
    """The first row of each group; ``order`` has to be given, a table has no row order."""
    return top_per_group(df, keys, order, 1, rank="_first", spread_by=spread_by).drop("_first")


def numbered(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """1-based position of every row in the order of the whole table, without one task for all.

    Rows are dealt out in ranges of the whole order, sorted and numbered within each range, and moved up
    by the number of rows in earlier ranges (one row per range). The numbered ranges are stored, as
    ranges of a second run could be others. ``order`` must be total for a repeatable result.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of a row in its partition fills the lower 33 bits
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_local", local), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    placed = ranged.join(before, "_range").withColumn(position, F.col("_before") + F.col("_local") + 1)
    return placed.drop("_range", "_local", "_before")


def position_in_group(
    df: DataFrame,
    key: str | list[str],
    order_by: list[str | Column],
    position: str = "position",
    count: str | None = None,
    most: int | None = None,
) -> DataFrame:
    """1-based position of every row within its group, also for groups of any size.

    Groups are counted when this is called, unless it is known that none has more than ``most`` rows, and those of up to
    ``GROUP_ROWS`` rows are dealt out by group and sorted, once. Rows of larger groups are numbered in the order of group and
    ``order_by`` over all of them, see ``numbered``; a group's positions begin at its first row, so a hot group is sorted by
    many tasks, whatever its values; these ranges are stored when this is called. Rows without a key are in no group and left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    known = df
    for name in keys:
        known = known.where(F.col(name).isNotNull())
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    hot = None
    if most is None or most > GROUP_ROWS:
        hot = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).where(F.col("_total") > GROUP_ROWS)
        hot = materialize(hot, "hot-groups")
        hot = hot if hot.count() else None
    group = Window.partitionBy(*keys)
    cold = known if hot is None else known.join(F.broadcast(hot), keys, "left_anti")
    placed = cold.select(*columns, F.row_number().over(group.orderBy(*order)).cast("long").alias(position))
    if count is not None:
        placed = placed.withColumn(count, F.count(F.lit(1)).over(group))
    if hot is None:
        return placed
    large = numbered(known.join(F.broadcast(hot.drop("_total")), keys, "left_semi"), [*[F.col(name) for name in keys], *order], "_place")
    groups = large.groupBy(*keys).agg(F.min("_place").alias("_first")).join(hot, keys)
    large = large.join(F.broadcast(groups), keys).withColumn(position, F.col("_place") - F.col("_first") + 1)
    if count is not None:
        large = large.withColumn(count, F.col("_total"))
    return placed.unionByName(large.select(*placed.columns))
