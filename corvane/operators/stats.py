"""Distributions, splits, classifiers and their scores; numeric experiments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.numbering import running


def softmax(df: DataFrame, group: str, logit: str, temperature: float = 1.0) -> DataFrame:
    """Adds p, the softmax of the logits of each group at a temperature, shifted by their maximum."""
    g = Window.partitionBy(group)
    e = F.exp((F.col(logit) - F.max(logit).over(g)) / temperature)
    return df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(g)).drop("_e")


def entropy_bits(p: Column) -> Column:
    """An aggregate; 0 log 0 is 0."""
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def kl_bits(p: Column, q: Column) -> Column:
    """An aggregate: of p relative to q, over the places where p > 0."""
    return F.sum(F.when(p > 0, p * F.log2(p / q)).otherwise(0.0))


def nucleus(df: DataFrame, group: str, item: str, p: str, mass: float) -> DataFrame:
    """The fewest items of each group that reach ``mass``, likeliest first, with cum and renorm."""
    upto = Window.partitionBy(group).orderBy(F.desc(p), item).rowsBetween(Window.unboundedPreceding, 0)
    kept = df.withColumn("cum", F.sum(p).over(upto)).filter(F.col("cum") - F.col(p) < mass)
    return kept.withColumn("renorm", F.col(p) / F.sum(p).over(Window.partitionBy(group)))


def stratified(df: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    """Adds train: the first ``floor(share * n)`` rows of each label by a hash of the key.

    Rows are counted by stretches of the hash, so no task holds a label.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_one", F.lit(1))
    placed = running(hashed, [label], ["_hash", key], "_hash", "_one", "_before", 1 << 52)
    return placed.join(counts, label).withColumn("train", F.col("_before") < F.floor(F.col("_n") * F.lit(share))).select(*df.columns, "train")


def subsample(df: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    """``floor(share * n)`` rows in total, dealt to the labels in proportion; all rows if ``share`` is 1.

    Each label gets the floor of its part; the rows that are then missing go to the labels of the largest remainders, the first of equals.
    """
    if share >= 1:
        return df
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # one row for each label
    part = F.col("_n") * F.lit(share)
    dealt = counts.crossJoin(F.broadcast(counts.agg(F.floor(F.sum("_n") * F.lit(share)).alias("_all"), F.sum(F.floor(part)).alias("_given"))))
    by_rest = Window.orderBy(F.desc(F.round(part - F.floor(part), 9)), label)
    dealt = dealt.withColumn("_take", F.floor(part) + (F.row_number().over(by_rest) <= F.col("_all") - F.col("_given")).cast("long"))
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_one", F.lit(1))
    placed = running(hashed, [label], ["_hash", key], "_hash", "_one", "_before", 1 << 52)
    return placed.join(dealt.select(label, "_take"), label).filter("_before < _take").select(*df.columns)


def class_shares(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(label, "n", (F.col("n") / F.col("_all")).alias("share"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, accuracy, f1_macro over the classes that stand in either column."""
    c = confusion(df, truth, guess)
    sides = c.select(F.col(truth).alias("c"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("g"))
    sides = sides.unionByName(c.select(F.col(guess).alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("g")))
    per = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("g").alias("g"))
    f1 = 2 * F.col("tp") / (F.col("t") + F.col("g"))
    return per.agg(F.sum("t").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("f1_macro"))


def class_moments(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, dim, n, mean, var (of the population): what Gaussian naive Bayes learns."""
    cells = df.select(label, F.posexplode(vector).alias("dim", "x"))
    return cells.groupBy(label, "dim").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x").cast("double")).alias("mean"), F.var_pop(F.col("x").cast("double")).alias("var"))


def naive_bayes(train: DataFrame, test: DataFrame, key: str, label: str, vector: str, smooth: float = 1e-9) -> DataFrame:
    """key, label, guess: Gaussian naive Bayes.  The model is a few numbers for each label and dimension; test rows meet it
    by dimension."""
    m = class_moments(train, label, vector)
    largest = train.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("v")).agg((F.max("v") * smooth).alias("eps"))
    total = train.agg(F.count(F.lit(1)).alias("total"))
    m = m.crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(total)).select(F.col(label).alias("class"), "dim", "mean", (F.col("var") + F.col("eps")).alias("var"), F.log(F.col("n") / F.col("total")).alias("prior"))
    cells = test.select(key, label, F.posexplode(vector).alias("dim", "x"))
    part = -0.5 * F.log(2 * np.pi * F.col("var")) - (F.col("x") - F.col("mean")) ** 2 / (2 * F.col("var"))
    like = cells.join(m, "dim").groupBy(key, label, "class").agg((F.sum(part) + F.first("prior")).alias("like"))
    return like.groupBy(key, label).agg(F.max_by("class", F.struct(F.round("like", 6), -F.col("class"))).alias("guess"))


def standard_scaled(train: DataFrame, df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """df with each dimension less the training mean, over the training deviation of the population."""
    m = train.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    model = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))), lambda s: F.struct(s["mean"].alias("mean"), F.when(s["sd"] == 0, 1.0).otherwise(s["sd"]).alias("sd"))).alias("_m"))
    return df.crossJoin(F.broadcast(model)).withColumn(vector, F.zip_with(vector, "_m", lambda x, s: (x.cast("double") - s["mean"]) / s["sd"])).select(*key, vector)


def logistic(train: DataFrame, test: DataFrame, key: str, label: str, vector: str, c: float = 1.0, rounds: int = 100) -> DataFrame:
    """key, label, guess: multinomial logistic regression with an L2 penalty of 1 / C, by Spark's own trainer."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def ready(df: DataFrame) -> DataFrame:
        return df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))

    n = train.count()
    fitted = LogisticRegression(maxIter=rounds, regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False).fit(ready(train))
    return fitted.transform(ready(test)).select(key, F.col("label").cast("int").alias(label), F.col("prediction").cast("int").alias("guess"))


def central_difference(f, x: Column, h: Column) -> Column:
    """(f(x + h) - f(x - h)) / (2 h) in doubles, not rounded."""
    return (f(x + h) - f(x - h)) / (2 * h)


def smallest_values(df: DataFrame, key: str, matrix: str, dtype: str) -> DataFrame:
    """key, sigma2, lam: the square of the least singular value, and the least eigenvalue of the Gram matrix, in ``dtype``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for rows in pdf[matrix]:
                m = np.array([list(r) for r in rows], dtype=dtype)
                found.append((float(np.linalg.svd(m, compute_uv=False)[-1] ** 2), float(np.linalg.eigvalsh(m.T @ m)[0])))
            yield pd.DataFrame({key: pdf[key], "sigma2": [a for a, _ in found], "lam": [b for _, b in found]})

    return df.select(key, matrix).mapInPandas(run, f"{key} long, sigma2 double, lam double")


def draws(df: DataFrame, key: str, p: str, n: int, seed: int = 0) -> DataFrame:
    """key, item, n: how often each item is drawn in n seeded draws from the row's probabilities, kept when never."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, probs in zip(pdf[key], pdf[p], strict=True):
                q = np.asarray(probs, float)
                counts = np.bincount(np.random.default_rng(seed).choice(len(q), size=n, p=q / q.sum()), minlength=len(q))
                yield pd.DataFrame({key: k, "item": np.arange(len(q)), "n": counts})

    return df.select(key, p).mapInPandas(run, f"{key} long, item int, n long")
