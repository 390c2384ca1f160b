"""Grouped descriptive statistics: describe, proportions, variability, box plots with outliers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = ("q25", "q50", "q75")
#: The largest 32-bit number.
LARGEST = 3.4028234663852886e38


def _same(a: str, b: str, keys: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def counted(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, v, c: how often each value occurs, 0 for null. All statistics are taken from this one exchange, which Spark makes
    once however often a plan reads it (so nulls are told by c, not v: a filter on v would go below it)."""
    return df.select(*keys, value.alias("v")).groupBy(*keys, "v").agg(F.count("v").alias("c"))


def summed(own: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean, std, min, QUARTILES (exact, interpolated) and max of counted() rows. Values are dealt into bins by their
    nearest 32-bit number, which keeps their order; bins are summed, and of a key's bins (8 million for each doubling of
    values at most, and no more than values) those that hold a wanted rank are opened. Deviations are taken within bins
    first, so that large values which differ little lose nothing. No join has fewer than (key, bin) as its key."""
    near = F.greatest(F.least(F.col("v").cast("float").cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    placed = own.withColumn("b", near)
    off = F.col("v") - F.col("b")
    bins = placed.groupBy(*keys, "b").agg(F.sum("c").alias("c"), F.sum(F.col("c") * off).alias("s1"), F.sum(F.col("c") * off * off).alias("s2"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("c").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumns({"n": F.sum("c").over(whole), "total": F.sum(F.col("c") * F.col("b") + F.col("s1")).over(whole), "min": F.min("lo").over(whole), "max": F.max("hi").over(whole), "before": before})
    away = F.col("b") - F.col("mean")
    bins = bins.withColumn("mean", F.try_divide("total", "n")).withColumn("squares", F.sum(F.col("s2") + 2 * away * F.col("s1") + F.col("c") * away * away).over(whole))
    ranks = F.array(*(F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), f(F.lit(p) * (F.col("n") - 1)).cast("long").alias("rank")) for i, p in enumerate((0.25, 0.5, 0.75)) for side, f in ((0, F.floor), (1, F.ceil))))
    bins = bins.withColumn("ranks", F.filter(ranks, lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("c"))))
    wanted = bins.where((F.size("ranks") > 0) | (F.col("n") == 0)).select(*keys, "b", "n", "mean", "squares", "min", "max", "before", "ranks")
    some = wanted.alias("w").join(placed.where("c > 0").alias("o"), _same("w", "o", [*keys, "b"]), "left").select("w.*", "o.v", "o.c")
    upto = F.sum("c").over(Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    some = some.withColumn("upto", F.col("before") + upto).withColumn("hit", F.explode_outer(F.filter("ranks", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("c")))))
    at = lambda i, side: F.max(F.when((F.col("hit.q") == i) & (F.col("hit.side") == side), F.col("v")))
    same = [F.max(c).alias(c) for c in ("n", "mean", "squares", "min", "max")]
    found = some.groupBy(*keys).agg(*same, *(at(i, side).alias(f"_{i}{side}") for i in range(3) for side in (0, 1)))
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    quarters = ((F.col(f"_{i}0") + (F.col(f"_{i}1") - F.col(f"_{i}0")) * part(p)).alias(QUARTILES[i]) for i, p in enumerate((0.25, 0.5, 0.75)))
    return found.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "mean", F.sqrt(F.try_divide("squares", F.col("n") - 1)).alias("std"), "min", *quarters, "max")


def describe(df: DataFrame, keys: list[str], column: str, digits: int) -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated) and max of the non-null values by keys, rounded half-even."""
    own = counted(df, keys, F.col(column).cast("double"))
    out = summed(own, keys)
    return out.select(*keys, F.col("n").alias("count"), *(F.bround(c, digits).alias(c) for c in ("mean", "std", "min", *QUARTILES, "max")))


def describe_many(df: DataFrame, keys: list[str], columns: list[str], digits: int) -> DataFrame:
    """describe() of several columns in long form, with the column `metric`."""
    return describe(_long(df, keys, columns), [*keys, "metric"], "value", digits)


def _long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    return df.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) AS (metric, value)"))


def proportions(df: DataFrame, keys: list[str], column: str, values: list[str], digits: int | None = None) -> DataFrame:
    """A column for each of the values: its share of the rows of the key, 0 where there are none."""
    share = lambda v: F.count_if(F.col(column).eqNullSafe(v)) / F.count("*")
    return df.groupBy(*keys).agg(*((F.bround(share(v), digits) if digits is not None else share(v)).alias(v) for v in values))


def variability(df: DataFrame, keys: list[str], document: list[str], column: str, values: list[str], digits: int = 3) -> DataFrame:
    """Sample standard deviation between documents of the proportions of the values; other values only count as rows."""
    per_document = proportions(df, [*keys, *document], column, values)
    return per_document.groupBy(*keys).agg(*(F.bround(F.stddev_samp(v), digits).alias(v) for v in values))


def _fenced(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, QUARTILES, v, c, and `outside`: -1 below, 1 above, 0 within 1.5 interquartile ranges of the box."""
    own = counted(df, keys, F.col(column).cast("double"))
    q = summed(own, keys)
    rows = own.where("c > 0").alias("o").join(q.alias("q"), _same("o", "q", keys)).select("o.*", *(f"q.{x}" for x in QUARTILES))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    return rows.withColumn("outside", F.when(F.col("v") < F.col("q25") - reach, -1).when(F.col("v") > F.col("q75") + reach, 1).otherwise(0))


def box(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """q25, q50, q75 and the whiskers: the outermost values within 1.5 interquartile ranges. Groups without values have no
    box; null is a group like any other."""
    inside = _fenced(df, keys, column).where("outside = 0")
    return inside.groupBy(*keys, *QUARTILES).agg(F.min("v").alias("whisker_low"), F.max("v").alias("whisker_high"))


def outliers(df: DataFrame, keys: list[str], column: str, axis: tuple[float, float] | None = None) -> DataFrame:
    """The points beyond the whiskers: keys, value, n (how often), side (-1 below, 1 above), and whether an axis from axis[0]
    to axis[1] shows it."""
    found = _fenced(df, keys, column).where("outside <> 0")
    shown = F.col("v").between(*axis) if axis else F.lit(True)
    return found.select(*keys, F.col("v").alias("value"), F.col("c").alias("n"), F.col("outside").alias("side"), shown.alias("shown"))


def clipped(df: DataFrame, keys: list[str], column: str, axis: tuple[float, float]) -> DataFrame:
    """keys, n, n_below, n_above: how many values an axis from axis[0] to axis[1] leaves out of a figure."""
    v = F.col(column).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(v < axis[0]).alias("n_below"), F.count_if(v > axis[1]).alias("n_above"))


def box_many(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """box() of several columns in long form, with the column `metric`."""
    return box(_long(df, keys, columns), [*keys, "metric"], "value")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys occur more than once; null equals null. Keys are counted within each task first, and the rows
    meet the repeated keys in a join, which Spark can split for a very common key."""
    often = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").alias("d")
    same = functools.reduce(lambda x, y: x & y, (F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys))
    return df.alias("r").join(often, same, "left_semi")


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows in this order."""
    return df.orderBy(*order).limit(n)


def row_at(df: DataFrame, order: list[str], place: int) -> DataFrame:
    """The one row at this place (from 0) of this order; none beyond the end."""
    return df.orderBy(*order).offset(place).limit(1)


def sample(df: DataFrame, strata: list[str], key: list[str], n: int, seed: str = "") -> DataFrame:
    """The n rows of each stratum whose keyed hash is least: the same rows however the table is cut or ordered, and for a
    smaller n a part of those for a larger one. The hash is the MD5 of seed and key; equal hashes (repeated keys) go by the
    key, and rows of one key are interchangeable. Each task hands on n rows of a stratum at most. `sample_rank` is added.
    Null is a stratum and a key like any other."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in key]
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), *parts)))
    order = Window.partitionBy(*strata).orderBy("_h", *key)
    # a limit by rank lets Spark keep the first n rows of each stratum before the exchange, too
    return rows.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= n).drop("_h")
