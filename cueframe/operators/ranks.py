"""Exact medians and percentiles by rank, never interpolated, without gathering a group.

Equal values are counted first, by partial sums. A group's distinct values are cut into CELLS cells of about as many each,
by a sketch of bounded size, so values far out cost nothing; a running sum over the counts of cells, a number of rows that
the data do not change, says in which cell each wanted rank lies. Only the values of these cells are put in order, by
group and cell. The sketch decides how the work is parted, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 64


def median() -> Column:
    """The upper median: place n / 2, counted from 0."""
    return F.floor(F.col("n") / 2)


def truncated(share: float) -> Column:
    """Place n * share, rounded down."""
    return F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1)


def rounded(share: float) -> Column:
    """Place share * (n - 1), rounded half to even."""
    return F.bround(F.lit(share) * (F.col("n") - 1), 0)


def at_ranks(rows: DataFrame, groups: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """(groups, n, one column for each wanted place) of the numbers in `value`. wanted: {name: a place from 0 by n}.

    Null values do not count, and groups without any other have no row; null is a group. Infinite values and NaN take part
    as Spark orders them. An empty table gives an empty one.
    """
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    number = F.col("_v").cast("double")
    plain = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    cuts = F.percentile_approx(plain, [i / CELLS for i in range(1, CELLS)], 16 * CELLS)
    ends = counts.groupBy(*groups).agg(cuts.alias("_cuts"), F.sum("_c").alias("n"))
    inside = F.size(F.filter("_cuts", lambda cut: cut < number))
    cell = F.when(number == float("-inf"), -1).when(F.isnan(number) | (number == float("inf")), CELLS).otherwise(inside)
    placed = counts.alias("a").join(ends.alias("b"), same("a", "b")).select("a.*", "b.n", cell.cast("int").alias("_cell"))

    upto = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = placed.groupBy(*groups, "_cell").agg(F.sum("_c").alias("_m"), F.first("n").alias("n")).withColumn("_before", F.sum("_m").over(upto) - F.col("_m"))
    picks = F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("k")) for name, place in wanted.items()))
    mine = F.filter(picks, lambda p: (p["k"] >= F.col("_before")) & (p["k"] < F.col("_before") + F.col("_m")))
    cells = cells.withColumn("_picks", mine).where(F.size("_picks") > 0)

    near = placed.alias("a").join(cells.alias("b"), [*same("a", "b"), F.col("a._cell") == F.col("b._cell")]).select("a.*", "b._before", "b._picks")
    order = Window.partitionBy(*groups, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_to", F.col("_before") + F.sum("_c").over(order)).withColumn("_pick", F.explode("_picks"))
    hit = near.where((F.col("_pick.k") < F.col("_to")) & (F.col("_pick.k") >= F.col("_to") - F.col("_c")))
    return hit.groupBy(*groups, "n").agg(*(F.max(F.when(F.col("_pick.name") == name, F.col("_v"))).alias(name) for name in wanted))


def weighted_mode(rows: DataFrame, group: str, value: str, weight: Column, order: Column) -> DataFrame:
    """(group, value, weight): the value with most weight in each group, of equal ones the one that is met first in order.
    Null values do not count; two partial aggregations, no group is gathered."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(weight).alias("weight"), F.min(order).alias("_first"))
    best = sums.groupBy(group).agg(F.min(F.struct((-F.col("weight")).alias("less"), "_first", value)).alias("b"))
    return best.select(group, F.col(f"b.{value}").alias(value), (-F.col("b.less")).alias("weight"))
