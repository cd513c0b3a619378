"""Islands, sessions, profiles and running statistics over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], step: str, period: int | None = None) -> DataFrame:
    """Runs of consecutive whole numbers in a column: first, last and size, by group.

    With a period, a run that ends at period - 1 is joined with one that starts at 0; its first is then greater than its last.
    """
    key = by or [F.lit(0)]
    w = Window.partitionBy(*key).orderBy(step)
    runs = df.select(*by, step).distinct().withColumn("__g", F.col(step) - F.row_number().over(w)).groupBy(*by, "__g").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("size"))
    if period is None:
        return runs.drop("__g")
    all_of = Window.partitionBy(*key)
    wraps = (F.min("first").over(all_of) == 0) & (F.max("last").over(all_of) == period - 1) & (F.count("*").over(all_of) > 1)
    marked = runs.withColumn("__w", wraps).withColumn("__g", F.when(F.col("__w") & (F.col("first") == 0), F.max("__g").over(all_of)).otherwise(F.col("__g")))
    head = F.when(F.col("__w") & (F.col("last") == period - 1), F.lit(1)).otherwise(0)
    tail = F.when(F.col("__w") & (F.col("first") == 0), F.lit(1)).otherwise(0)
    joined = marked.withColumns({"__h": head, "__t": tail, "__g": F.when(head + tail > 0, F.lit(None)).otherwise(F.col("__g"))})
    return joined.groupBy(*by, "__g").agg(
        F.coalesce(F.max(F.when(F.col("__h") == 1, F.col("first"))), F.min("first")).alias("first"), F.coalesce(F.max(F.when(F.col("__t") == 1, F.col("last"))), F.max("last")).alias("last"), F.sum("size").alias("size")
    ).drop("__g")


def sessions(df: DataFrame, by: list[str], at: str, gap: float) -> DataFrame:
    """Adds session (from 0): a new one begins where a value is at least gap after the one before."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) >= gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def moving_average(df: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """Mean of the last width rows, only where there are as many."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), 0)
    return df.withColumns({"moving": F.avg(value).over(w), "__n": F.count(F.lit(1)).over(w)}).where(F.col("__n") == width).drop("__n")


def local_maxima(df: DataFrame, by: list[str], order: str, value: str, reach: int) -> DataFrame:
    """Rows greater than all others within reach rows on both sides."""
    w = Window.partitionBy(*by).orderBy(order)
    left, right = F.max(value).over(w.rowsBetween(-reach, -1)), F.max(value).over(w.rowsBetween(1, reach))
    return df.withColumns({"__l": left, "__r": right}).where((F.col(value) > F.coalesce("__l", F.lit(float("-inf")))) & (F.col(value) > F.coalesce("__r", F.lit(float("-inf"))))).drop("__l", "__r")


def upper_median(column) -> F.Column:
    """Of an even number of values the upper middle one, as an aggregate."""
    values = F.sort_array(F.collect_list(column))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def upper_median_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n and upper_median, from counts of distinct values, so that no task holds a group's rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    key = by or [F.lit(0)]
    w = Window.partitionBy(*key)
    ranked = counts.withColumns({"upto": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    return ranked.where(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy(*by, "n").agg(F.min(value).alias("upper_median"))


def filled_bins(df: DataFrame, by: list[str], bin_column: str, bins: DataFrame, value: F.Column) -> DataFrame:
    """value by group and bin, 0 in bins without rows. bins: one column named as bin_column, a stated list."""
    groups = df.select(*by).distinct()
    wanted = [r[0] for r in bins.select(bin_column).limit(100_001).collect()]
    if len(wanted) > 100_000:
        raise ValueError("too many bins for a stated list")
    grid = groups.withColumn(bin_column, F.explode(F.array(*map(F.lit, wanted))))
    found = df.groupBy(*by, bin_column).agg(value.alias("value"))
    return grid.join(found, [*by, bin_column], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def interpolated_bins(df: DataFrame, at: str, value: str, start: float, stop: float, width: float) -> DataFrame:
    """bin and value: mean of the rows in each bin [start, start + width) ..., of an empty bin the line through the rows around its middle.

    Before the first and after the last row the line through the two outermost ones goes on. Rows from start to stop, both
    included, count. Of rows at one place the line takes the least value. With fewer than two places an empty bin stays null.
    The bins are a stated list, one window.
    """
    bins = int((stop - start) / width)
    known = df.where(F.col(at).isNotNull() & F.col(value).isNotNull() & F.col(at).between(start, stop)).select(F.col(at).cast("double").alias("a"), F.col(value).cast("double").alias("v"))
    places = known.groupBy("a").agg(F.min("v").alias("v"))
    low, high = ([(r["a"], r["v"]) for r in places.orderBy(order).limit(2).collect()] for order in (F.col("a").asc(), F.col("a").desc()))
    means = known.where(F.col("a") < start + bins * width).groupBy(F.floor((F.col("a") - start) / width).alias("k")).agg(F.avg("v").alias("mean"))
    ends = places.groupBy(F.least(F.floor((F.col("a") - start) / width), F.lit(bins)).alias("k")).agg(F.min(F.struct("a", "v")).alias("first"), F.max(F.struct("a", "v")).alias("last"))
    grid = df.sparkSession.range(bins + 1).select(F.col("id").alias("k")).join(means, "k", "left").join(ends, "k", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("k")
    both = grid.withColumns({"l": F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "r": F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where(F.col("k") < bins)
    middle = F.lit(start) + (F.col("k") + 0.5) * width

    def through(p, q) -> F.Column:
        (x0, y0), (x1, y1) = p, q
        return y0 + (y1 - y0) * (middle - x0) / (x1 - x0)

    inside = through((F.col("l.a"), F.col("l.v")), (F.col("r.a"), F.col("r.v")))
    out = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), inside)
    if len(low) == 2:
        lit = lambda pair: tuple(map(F.lit, pair))
        out = out.when(F.col("l").isNull(), through(lit(low[0]), lit(low[1]))).otherwise(through(lit(high[1]), lit(high[0])))
    return both.select((F.lit(start) + F.col("k") * width).alias("bin"), F.coalesce("mean", out).alias("value"))


def on_curve(points: DataFrame, at: str, curve: list[tuple[float, float]], name: str) -> DataFrame:
    """Adds the value of a piecewise linear curve, given as sorted (x, y), held at its ends: one CASE, no join."""
    x = F.col(at)
    out = F.when(x <= curve[0][0], F.lit(float(curve[0][1])))
    for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - float(x0)) * ((y1 - y0) / (x1 - x0)))
    return points.withColumn(name, out.when(x.isNotNull(), F.lit(float(curve[-1][1]))))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0) and n of equal bins; the last one holds its upper edge."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(*by, k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rank_in_null(null: DataFrame, value: str, observed: float) -> DataFrame:
    """rank (1 + values at least as high), trials, percentile, its binomial standard error and an upper bound of p.

    The bound is 3 / n where no value reaches the observed one, else p plus 1.96 standard errors.
    """
    s = null.agg(F.count_if(F.col(value) >= observed).alias("ge"), F.count(value).alias("n"))
    p = (F.col("ge") + 1) / (F.col("n") + 1)
    se = F.sqrt(p * (1 - p) / F.col("n"))
    return s.select((F.col("ge") + 1).alias("rank"), F.col("n").alias("trials"), ((1 - (F.col("ge") + 1) / (F.col("n") + 1)) * 100).alias("percentile"), se.alias("se"), F.when(F.col("ge") == 0, 3.0 / F.col("n")).otherwise(p + 1.96 * se).alias("p_bound"))
