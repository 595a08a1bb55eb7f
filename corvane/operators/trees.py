"""A decision tree for classes, grown level by level from histograms.

Each dimension is cut into equal bins between its least and greatest training value.  A level counts rows by node,
dimension, bin and label in one shuffle (combined before it), finds the cut of least Gini impurity of every node from
those counts, and passes each row to its side.  Rows never meet in one task: what a window sees is one node's bins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.scratch import saved

MOST_DEPTH = 12  # the splits of a tree, fewer than 2 ** MOST_DEPTH rows, are broadcast


class Tree(NamedTuple):
    edges: DataFrame  #: one row: the least value and the width of each dimension, and how many bins
    splits: DataFrame  #: node, dim, bin: rows of greater bins go to child 2 * node + 1, the others to 2 * node
    leaves: DataFrame  #: node, guess, n
    depth: int


def _edges(train: DataFrame, vector: str, bins: int) -> DataFrame:
    x = F.col("x").cast("double")
    span = train.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.min(x).alias("low"), F.max(x).alias("high"))
    return span.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))), lambda s: F.struct(s["low"].alias("low"), (s["high"] - s["low"]).alias("width"))).alias("_edges"), F.lit(bins).alias("_bins"))


def _binned(df: DataFrame, edges: DataFrame, vector: str) -> DataFrame:
    """Adds _at: the bin of each dimension.  Values outside what training saw are in the outer bins."""
    place = lambda x, e: F.when(e["width"] > 0, F.floor((x.cast("double") - e["low"]) / e["width"] * F.col("_bins"))).otherwise(0)
    at = F.zip_with(vector, "_edges", lambda x, e: F.greatest(F.lit(0), F.least(F.col("_bins") - 1, place(x, e))).cast("int"))
    return df.crossJoin(F.broadcast(edges)).withColumn("_at", at).drop("_edges", "_bins")  # one row


def _passed_on(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows one level further down; those of nodes without a split stay."""
    s = F.broadcast(splits.select("node", F.col("dim").alias("_dim"), F.col("bin").alias("_bin")))
    side = (F.get("_at", F.col("_dim")) > F.col("_bin")).cast("long")
    return rows.join(s, "node", "left").withColumn("node", F.when(F.col("_dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side)).drop("_dim", "_bin")


def best_splits(rows: DataFrame, label: str, least: int = 1) -> DataFrame:
    """node, dim, bin of the best cut of each node; of equals that of the least dimension, then bin.  rows: node, label, _at.

    The sums of squared class counts on both sides of a cut come from running sums of their changes, so that counts
    need not be dense.  Nodes that no cut makes purer have no row; nor are there cuts that leave a side of fewer than ``least`` rows.
    """
    h = rows.select("node", label, F.posexplode("_at").alias("dim", "bin")).groupBy("node", "dim", "bin", label).agg(F.count(F.lit(1)).alias("n"))
    own, cut = Window.partitionBy("node", "dim", label), Window.partitionBy("node", "dim")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("left", F.sum("n").over(upto)).withColumn("right", F.sum("n").over(own) - F.col("left"))
    was_left, was_right = F.col("left") - F.col("n"), F.col("right") + F.col("n")
    step = h.groupBy("node", "dim", "bin").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("left") * F.col("left") - was_left * was_left).alias("more"),
        F.sum(was_right * was_right - F.col("right") * F.col("right")).alias("fewer"),
    )
    run = cut.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = step.select("node", "dim", "bin", F.sum("n").over(run).alias("nl"), F.sum("n").over(cut).alias("all"), F.sum("more").over(run).alias("sl"), F.sum("fewer").over(cut).alias("whole"), F.sum("fewer").over(run).alias("lost"))
    s = s.withColumn("nr", F.col("all") - F.col("nl")).filter((F.col("nl") >= least) & (F.col("nr") >= least))
    purity = F.round(F.col("sl") / F.col("nl") + (F.col("whole") - F.col("lost")) / F.col("nr"), 6)
    s = s.withColumn("purity", purity).filter(F.col("purity") > F.round(F.col("whole") / F.col("all"), 6))
    best = s.groupBy("node").agg(F.max_by(F.struct("dim", "bin"), F.struct("purity", -F.col("dim"), -F.col("bin"))).alias("best"))
    return best.select("node", "best.dim", "best.bin")


def grow(train: DataFrame, label: str, vector: str, depth: int = 3, bins: int = 32, least: int = 1) -> Tree:
    """A tree of at most ``depth`` levels of cuts.  A leaf guesses its commonest label, the least of equals.

    Rows with a null vector or label are left out; without rows there are no leaves, and every guess is null.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"a depth of 0 to {MOST_DEPTH}, as the splits are broadcast")
    known = train.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    edges = saved(_edges(known, vector, bins), "tree_edges")
    rows = saved(_binned(known, edges, vector).select(F.lit(1).cast("long").alias("node"), label, "_at"), "tree_rows")
    splits = rows.sparkSession.createDataFrame([], "node long, dim int, bin int")
    for level in range(depth):
        found = saved(best_splits(rows.filter(F.col("node") >= 2**level), label, least), "tree_splits")
        if found.isEmpty():
            break
        splits = splits.unionByName(found)
        rows = saved(_passed_on(rows, found), "tree_rows")
    counts = rows.groupBy("node", label).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("_place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), label)))  # one row for each label
    leaves = ranked.groupBy("node").agg(F.max(F.when(F.col("_place") == 1, F.col(label))).alias("guess"), F.sum("n").alias("n"))
    return Tree(edges, splits, saved(leaves, "tree_leaves"), depth)


def predict(tree: Tree, df: DataFrame, vector: str) -> DataFrame:
    """``df`` with node, the leaf of each row, and guess; both null where the vector is null.  ``df`` must not have columns of these names."""
    rows = _binned(df, tree.edges, vector).withColumn("node", F.when(F.col(vector).isNotNull(), F.lit(1).cast("long")))
    for _ in range(tree.depth):
        rows = _passed_on(rows, tree.splits)
    return rows.join(F.broadcast(tree.leaves.select("node", "guess")), "node", "left").select(*df.columns, "node", "guess")
