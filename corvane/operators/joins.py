"""Joins by nearness: tolerance, nearest earlier, boxes, snapshots, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numbers import tolerance


def supported(asked: DataFrame, measured: DataFrame) -> DataFrame:
    """The rows of asked (value, decimals, ...) that some measured (value) is within half a unit of the last place of.

    Both sides meet in buckets as wide as the tolerance of their decimals, a value also in the two next to its own, so
    the join is by equality however large both sides are.  Only distinct values are compared.
    """
    want = asked.select("value", "decimals").distinct().filter("value is not null")
    slack = F.ceil(F.log10(2e-12 * F.abs("value"))).cast("int")
    want = want.withColumn("scale", F.greatest(-F.col("decimals"), slack)).withColumn("width", F.pow(F.lit(10.0), "scale"))
    want = want.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("value") / F.col("width")) + k)))
    scales = want.select("scale", "width").distinct()  # one row for each power of ten, so some dozens
    have = measured.select(F.col("value").alias("m")).filter("m is not null").distinct().crossJoin(F.broadcast(scales)).withColumn("cell", F.floor(F.col("m") / F.col("width")))
    near = want.join(have.select("m", "scale", "cell"), ["scale", "cell"]).filter(F.abs(F.col("m") - F.col("value")) <= tolerance(F.col("value"), F.col("decimals")))
    return asked.join(near.select("value", "decimals").distinct(), ["value", "decimals"], "left_semi")


def nearest_earlier(left: DataFrame, right: DataFrame, by: str, at: str, pick: str) -> DataFrame:
    """Adds to each left row (by, at, ...) the ``pick`` of the right row of the same key that stands last before it."""
    extra = [c for c in left.columns if c not in (by, at)]
    both = left.withColumn("_side", F.lit(1)).withColumn(pick, F.lit(None).cast(right.schema[pick].dataType)).unionByName(
        right.select(by, at, pick, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra])
    )
    before = Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn(pick, F.last(pick, True).over(before)).filter("_side = 1").drop("_side")


#: Widths of the grids are powers of two from the first on; a rectangle stands in the grid of the first width that is no less than its own.
WIDTHS = range(3, 24)


def _grid_of() -> Column:
    spread = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0))
    return F.least(F.greatest(F.ceil(F.log2(spread)), F.lit(WIDTHS[0])), F.lit(WIDTHS[-1])).cast("int")


def _cells(df: DataFrame, widths: list[int]) -> DataFrame:
    """df with own, the grid of each rectangle, and its cells there and in all wider grids of ``widths``: four at most in each."""
    df = df.withColumn("_own", _grid_of()).withColumn("_grid", F.explode(F.array(*map(F.lit, widths)))).filter("_grid >= _own")
    width = F.pow(F.lit(2.0), "_grid")
    side = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))
    return df.withColumn("_cx", F.explode(side("x0", "x1"))).withColumn("_cy", F.explode(side("y0", "y1")))


def outside_boxes(lines: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """The lines (x0, y0, x1, y1, ...) that no box of their page meets; rectangles that only touch do not meet.

    Lines and boxes meet by cell: two rectangles are compared in the grid whose cells are as wide as the larger of them, so a
    page of many small boxes costs each line its neighbours, not the page.
    """
    line, meets = lines.columns, (F.col("x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("x1")) & (F.col("y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("y1"))
    spot = ["x0", "y0", "x1", "y1"]
    shapes = lines.select(*page, *spot).distinct()
    every = boxes.select(*page, *spot).distinct()
    reach = shapes.unionByName(every).agg(F.min(_grid_of()).alias("a"), F.max(_grid_of()).alias("b")).first()
    if reach["a"] is None:
        return lines
    widths = list(range(int(reach["a"]), int(reach["b"]) + 1))
    l, b = _cells(shapes, widths), _cells(every, widths).select(*page, "_grid", "_cx", "_cy", F.col("_own").alias("_other"), *[F.col(c).alias(f"b_{c}") for c in spot])
    met = l.join(b, [*page, "_grid", "_cx", "_cy"]).filter((F.col("_grid") == F.greatest("_own", "_other")) & meets).select(*page, *spot).distinct()
    return lines.join(met, [*page, *spot], "left_anti").select(*line)


def changed(before: DataFrame, after: DataFrame, key: str, stamp: str) -> DataFrame:
    """The rows of ``after`` that are new or whose stamp differs from before; what is gone is passed over."""
    old = before.select(key, F.col(stamp).alias("_old"))
    return after.join(old, key, "left").filter(~F.col(stamp).eqNullSafe(F.col("_old"))).drop("_old")


def zipped(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, pos, a, b: two arrays side by side, as far as the shorter one goes."""
    n = F.least(F.size(a), F.size(b))
    return df.select(key, F.posexplode(F.slice(F.arrays_zip(a, b), F.lit(1), n)).alias("pos", "z")).select(key, "pos", F.col(f"z.{a}").alias(a), F.col(f"z.{b}").alias(b))
