"""Queries of distributions, splits, classifiers and numeric experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import stats as M
from corvane.operators import trees
from corvane.sources.tables import table


def _logits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("tok", "x")).select("vec_id", "tok", (F.col("x").cast("double") * 10).alias("logit"))


def softmax_entropy(s: SparkSession, d: str) -> DataFrame:
    """The entropy in bits of each vector's softmax at three temperatures."""
    x = _logits(s, d)
    parts = [M.softmax(x, "vec_id", "logit", t).groupBy("vec_id").agg(F.round(M.entropy_bits(F.col("p")), 6).alias("bits")).withColumn("t", F.lit(t)) for t in (0.5, 1.0, 2.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_p(s: SparkSession, d: str) -> DataFrame:
    n = M.nucleus(M.softmax(_logits(s, d), "vec_id", "logit"), "vec_id", "tok", "p", 0.9)
    return n.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("cum"), 6).alias("mass"), F.round(F.max("renorm"), 6).alias("best"))


def kl_bits(s: SparkSession, d: str) -> DataFrame:
    """Of each vector's softmax relative to the one at twice the temperature."""
    x = _logits(s, d)
    q = M.softmax(x, "vec_id", "logit", 2.0).select("vec_id", "tok", F.col("p").alias("q"))
    both = M.softmax(x, "vec_id", "logit", 1.0).join(q, ["vec_id", "tok"])
    return both.groupBy("vec_id").agg(F.round(M.kl_bits(F.col("p"), F.col("q")), 6).alias("kl"), F.round(M.kl_bits(F.col("q"), F.col("p")), 6).alias("reverse"))


def central_difference(s: SparkSession, d: str) -> DataFrame:
    """Of f(w) = w * w * price at w = 2, with a step that the line number sets."""
    li = table(s, d, "lineitem")
    h = F.pow(F.lit(10.0), -(F.col("l_linenumber") % 4).cast("double") - 1)
    g = M.central_difference(lambda w: w * w * F.col("l_quantity"), F.lit(2.0), h)
    return li.select("l_linenumber", g.alias("g"), (F.col("l_quantity") * 4).alias("exact")).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("g") - F.col("exact"))), 6).alias("worst"))


def conditioning(s: SparkSession, d: str) -> DataFrame:
    """Nearly parallel columns for each part, closer for larger sizes: least singular value and eigenvalue in both types."""
    e = F.pow(F.lit(10.0), -(F.col("p_size") % 5).cast("double"))
    m = table(s, d, "part").select("p_partkey", F.array(F.array(F.lit(1.0), F.lit(1.0)), F.array(e, F.lit(0.0)), F.array(F.lit(0.0), e)).alias("m"))
    low, high = (M.smallest_values(m, "p_partkey", "m", t) for t in ("float32", "float64"))
    return low.withColumnsRenamed({"sigma2": "sigma2_32", "lam": "lam_32"}).join(high.withColumnsRenamed({"sigma2": "sigma2_64", "lam": "lam_64"}), "p_partkey")


def conditioning_error(s: SparkSession, d: str) -> DataFrame:
    """How far the double-precision value is from the exact one, e squared, by size class."""
    c = conditioning(s, d).join(table(s, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("k")), "p_partkey")
    exact = F.pow(F.lit(10.0), -2.0 * F.col("k"))
    return c.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("sigma2_64") - exact) / exact) < 1e-9).alias("near"))


def stratified_split(s: SparkSession, d: str) -> DataFrame:
    x = M.stratified(table(s, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.7)
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("train").cast("long")).alias("n_train"))


def class_shares(s: SparkSession, d: str) -> DataFrame:
    return M.class_shares(table(s, d, "labels"), "quality").withColumn("share", F.round("share", 6))


def confusion_f1(s: SparkSession, d: str) -> DataFrame:
    out = M.scores(table(s, d, "labels"), "quality", "toxic")
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings").select("vec_id", "label", "embedding")
    return e.filter("vec_id % 10 < 7"), e.filter("vec_id % 10 >= 7")


def nb_predictions(s: SparkSession, d: str) -> DataFrame:
    train, test = _split(s, d)
    return M.naive_bayes(train, test, "vec_id", "label", "embedding").select("vec_id", "label", "guess")


def nb_metrics(s: SparkSession, d: str) -> DataFrame:
    out = M.scores(nb_predictions(s, d), "label", "guess")
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


def standard_scaled(s: SparkSession, d: str) -> DataFrame:
    train, test = _split(s, d)
    z = M.standard_scaled(train, test, ["vec_id"], "embedding")
    return z.select("vec_id", F.posexplode("embedding").alias("dim", "z")).select("vec_id", F.col("dim").cast("int").alias("dim"), F.round("z", 5).alias("z"))


def lr_metrics(s: SparkSession, d: str) -> DataFrame:
    """Logistic regression on scaled vectors; its trainer is iterative, so only the row's shape is fixed."""
    train, test = _split(s, d)
    both = [M.standard_scaled(train, x, ["vec_id", "label"], "embedding") for x in (train, test)]
    return M.scores(M.logistic(*both, "vec_id", "label", "embedding"), "label", "guess")


def tree_leaves(s: SparkSession, d: str) -> DataFrame:
    """The leaves of a tree of two levels on the training vectors: their guess, and how many training and other rows fall into each."""
    train, test = _split(s, d)
    tree = trees.grow(train, "label", "embedding", depth=2, bins=16)
    seen = trees.predict(tree, test, "embedding").groupBy("node").agg(F.count(F.lit(1)).alias("n_test"), F.sum((F.col("label") == F.col("guess")).cast("long")).alias("n_right"))
    return tree.leaves.join(seen, "node", "left").select("node", "guess", "n", F.coalesce("n_test", F.lit(0)).alias("n_test"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def learning_curve(s: SparkSession, d: str) -> DataFrame:
    """Naive Bayes accuracy on growing nested shares of the training rows."""
    train, test = _split(s, d)
    out = None
    for share in (0.05, 0.1, 0.25, 0.5, 1.0):
        part = M.subsample(train, "vec_id", "label", share)
        row = M.scores(M.naive_bayes(part, test, "vec_id", "label", "embedding"), "label", "guess").withColumn("share", F.lit(share))
        out = row if out is None else out.unionByName(row)
    return out


def seeded_draws(s: SparkSession, d: str) -> DataFrame:
    p = M.softmax(_logits(s, d), "vec_id", "logit").groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok", "p"))), lambda x: x["p"]).alias("p"))
    return M.draws(p, "vec_id", "p", 1000).groupBy("vec_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))


QUERIES = {
    f.__name__: f
    for f in (softmax_entropy, top_p, kl_bits, central_difference, conditioning, conditioning_error, stratified_split, class_shares, confusion_f1, nb_predictions, nb_metrics, standard_scaled, lr_metrics, tree_leaves, learning_curve, seeded_draws)
}

_SOFT = """x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS tok, CAST(unnest(embedding) AS DOUBLE) * 10 AS l FROM embeddings),
  mx AS (SELECT vec_id, max(l) AS m FROM x GROUP BY vec_id), ts AS (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS t),
  e AS (SELECT vec_id, tok, t, exp((l - m) / t) AS e FROM x JOIN mx USING (vec_id), ts), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, t) AS p FROM e)"""
_NB = """tr AS (SELECT label AS c, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 < 7),
  eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(x) AS v FROM tr GROUP BY dim)), tot AS (SELECT count(*) AS total FROM embeddings WHERE vec_id % 10 < 7),
  mo AS (SELECT c, dim, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM tr GROUP BY c, dim),
  te AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 >= 7),
  li AS (SELECT vec_id, label, c, sum(-0.5::DOUBLE * ln(2 * pi() * (var + eps)) - (x - mean) * (x - mean) / (2 * (var + eps))) + any_value(ln(n / total::DOUBLE)) AS ll FROM te JOIN mo USING (dim), eps, tot GROUP BY vec_id, label, c),
  nb AS (SELECT vec_id, label, arg_max(c, (round(ll, 6), -c)) AS guess FROM li GROUP BY vec_id, label)"""


def _tree_level(rows: str, out: str) -> str:
    """CTEs: the best cuts of the nodes of a level, by trying every cut of the counts, and the rows passed on."""
    return f"""{out}_h AS (SELECT node, dim, bin, c, count(*) AS n FROM {rows} WHERE train AND open GROUP BY ALL),
  {out}_cuts AS (SELECT DISTINCT node, dim, bin AS cut FROM {out}_h),
  {out}_sides AS (SELECT k.node, k.dim, k.cut, c, sum(CASE WHEN bin <= cut THEN n ELSE 0 END) AS l, sum(CASE WHEN bin > cut THEN n ELSE 0 END) AS r FROM {out}_cuts k JOIN {out}_h h ON k.node = h.node AND k.dim = h.dim GROUP BY ALL),
  {out}_pure AS (SELECT node, dim, cut, round(sum(l * l) / sum(l) + sum(r * r) / nullif(sum(r), 0), 6) AS p, round(sum((l + r) * (l + r)) / sum(l + r), 6) AS was FROM {out}_sides GROUP BY ALL),
  {out}_best AS (SELECT node, arg_max(dim, (p, -dim, -cut)) AS d, arg_max(cut, (p, -dim, -cut)) AS cut FROM {out}_pure WHERE p > was GROUP BY node),
  {out}_to AS (SELECT x.vec_id, CASE WHEN b.d IS NULL THEN x.node ELSE 2 * x.node + CAST(x.bin > b.cut AS INTEGER) END AS node, b.d IS NOT NULL AS open FROM {rows} x LEFT JOIN {out}_best b ON b.node = x.node AND x.open WHERE x.dim = coalesce(b.d, 0)),
  {out} AS (SELECT x.vec_id, x.c, x.train, t.node, t.open, x.dim, x.bin FROM {rows} x JOIN {out}_to t USING (vec_id))"""


_TREE = """raw AS (SELECT vec_id, label AS c, vec_id % 10 < 7 AS train, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  ed AS (SELECT dim, min(x) AS low, max(x) - min(x) AS width FROM raw WHERE train GROUP BY dim),
  r0 AS (SELECT vec_id, c, train, 1::BIGINT AS node, TRUE AS open, dim, CASE WHEN width > 0 THEN greatest(0, least(15, floor((x - low) / width * 16))) ELSE 0 END AS bin FROM raw JOIN ed USING (dim))"""


def _f1(rows: str, a: str, b: str) -> str:
    return f"""k AS (SELECT DISTINCT c FROM (SELECT {a} AS c FROM {rows} UNION ALL SELECT {b} FROM {rows})),
      f AS (SELECT c, 2.0::DOUBLE * (SELECT count(*) FROM {rows} WHERE {a} = c AND {b} = c) / ((SELECT count(*) FROM {rows} WHERE {a} = c) + (SELECT count(*) FROM {rows} WHERE {b} = c)) AS f1 FROM k)
      SELECT (SELECT count(*) FROM {rows}) AS n, round((SELECT avg(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0 END) FROM {rows}), 6) AS accuracy, round(avg(f1), 6) AS f1_macro FROM f"""


SQL = {
    "softmax_entropy": f"WITH {_SOFT} SELECT vec_id, t, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS bits FROM p GROUP BY vec_id, t",
    "top_p": f"""WITH {_SOFT}, c AS (SELECT vec_id, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING) AS cum FROM p WHERE t = 1),
      k AS (SELECT * FROM c WHERE cum - p < 0.9::DOUBLE) SELECT vec_id, count(*) AS n, round(max(cum), 6) AS mass, round(max(p) / sum(p), 6) AS best FROM k GROUP BY vec_id""",
    "kl_bits": f"""WITH {_SOFT} SELECT a.vec_id, round(sum(CASE WHEN a.p > 0 THEN a.p * log2(a.p / b.p) ELSE 0 END), 6) AS kl, round(sum(CASE WHEN b.p > 0 THEN b.p * log2(b.p / a.p) ELSE 0 END), 6) AS reverse
      FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.tok = b.tok WHERE a.t = 1 AND b.t = 2 GROUP BY a.vec_id""",
    "central_difference": """WITH h AS (SELECT l_linenumber, l_quantity AS q, pow(10.0::DOUBLE, -(l_linenumber % 4) - 1) AS h FROM lineitem)
      SELECT l_linenumber, count(*) AS n, round(max(abs(((2 + h) * (2 + h) * q - (2 - h) * (2 - h) * q) / (2 * h) - 4 * q)), 6) AS worst FROM h GROUP BY 1""",
    "conditioning_error": "SELECT p_size % 5 AS k, count(*) AS n, TRUE AS near FROM part GROUP BY 1",
    "stratified_split": "SELECT label, count(*) AS n, CAST(floor(count(*) * 0.7::DOUBLE) AS BIGINT) AS n_train FROM embeddings GROUP BY label",
    "class_shares": "SELECT quality, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share FROM labels GROUP BY quality",
    "confusion_f1": "WITH " + _f1("labels", "quality", "toxic"),
    "nb_predictions": f"WITH {_NB} SELECT vec_id, label, guess FROM nb",
    "nb_metrics": f"WITH {_NB}, " + _f1("nb", "label", "guess"),
    "standard_scaled": """WITH tr AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 < 7), m AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS sd FROM tr GROUP BY dim),
      te AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 >= 7)
      SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((x - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS z FROM te JOIN m USING (dim)""",
    "tree_leaves": f"""WITH {_TREE}, {_tree_level("r0", "r1")}, {_tree_level("r1", "r2")}, one AS (SELECT * FROM r2 WHERE dim = 0),
      cnt AS (SELECT node, c, count(*) AS n FROM one WHERE train GROUP BY ALL), leaf AS (SELECT node, arg_max(c, (n, -c)) AS guess, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY node)
      SELECT l.node, guess, n, count(o.vec_id) AS n_test, count(o.vec_id) FILTER (o.c = guess) AS n_right FROM leaf l LEFT JOIN one o ON o.node = l.node AND NOT o.train GROUP BY ALL""",
    "seeded_draws": "SELECT vec_id, CAST(1000 AS BIGINT) AS n, CAST(len(embedding) AS BIGINT) AS items FROM embeddings",
}
