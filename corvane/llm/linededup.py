"""Line dedup with levelled sorted runs, in DataFrame functions only.

The keys met so far are held in runs: tables sorted by key and bucketed by it, with ``k1, k2`` (a 128-bit hash of the key), ``n``
(documents that hold it) and ``last`` (the largest doc_id that holds it).  Each new batch of documents is merge-anti-joined
with the runs; the keys that no run holds become the batch's own run at level 0, so that every key stands in one run
only.  What the batch adds to keys of older runs is written apart, as increments.  As soon as a level holds ``FAN`` runs they
are compacted into one run of the next level.  Buckets let a batch meet the runs without moving or reading them twice.

A key's count is that of its run plus its increments; keys of enough documents are kept, and the lines of every document
are merge-joined with them.  A folder of runs outlives a call: batches that come later are added by opening it again.

Defined cases: a null text is one empty line; a null doc_id counts as a document, holds no "largest" place and keeps no
line of a key held elsewhere; every row counts as one document, so a repeated row counts again, and rows that share the
largest doc_id all keep the line; an empty table gives an empty result; further columns are kept by
:func:`dedup`, but for n_lines and n_dropped, which it sets; names of columns never clash with helpers.
Keys are compared by 128 bits of hash.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import WHITE, fresh, partitions, saved, scratch, sha256_text

#: Keys shorter than this many code points are never dropped; a key must be held by this many documents.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of one call, and runs of a level that are merged into one of the next.
BATCHES, FAN = 4, 3


def line_key(line: Column) -> Column:
    """A pair of hashes, equal for lines that are equal once stripped and with A-Z lower-cased.

    Only A-Z may be lower-cased.  The bytes of the line are read as Latin-1 before lower(): that changes A-Z and some
    lead bytes of UTF-8, those always alike, so that different lines stay different and É stays apart from é.
    """
    low = F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"))
    one = F.xxhash64(low)
    return F.struct(one.alias("k1"), F.xxhash64(F.lit(7), low).alias("k2"))


def line_keys(text: Column) -> Column:
    """The keys of the lines of a text, in order; null for a line too short to be dropped."""

    def of(line: Column) -> Column:
        return F.when(F.length(line) >= MIN_CHARS, line_key(line))

    return F.transform(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE))), of)


def held(docs: DataFrame) -> DataFrame:
    """One row for each line that may be dropped: its document (id and hash of the text), key, place, and whether it is
    the first such line of its document."""
    df = docs.select("doc_id", _hash().alias("x"), line_keys(F.coalesce(F.col("text"), F.lit(""))).alias("_k"))
    placed = F.transform("_k", lambda k, i: F.when(k.isNotNull(), F.struct(k["k1"].alias("k1"), k["k2"].alias("k2"), i.alias("pos"))))
    df = df.withColumn("_s", F.array_sort(F.filter(placed, lambda k: k.isNotNull())))

    def mark(k: Column, j: Column) -> Column:
        before = F.get("_s", j - 1)
        return F.struct(k["k1"].alias("k1"), k["k2"].alias("k2"), k["pos"].alias("pos"), F.coalesce((before["k1"] != k["k1"]) | (before["k2"] != k["k2"]), F.lit(True)).alias("first"))

    return df.select("doc_id", "x", F.explode(F.transform("_s", mark)).alias("k")).select("doc_id", "x", "k.*")


def _hash() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0))


class Runs:
    """Levelled runs in a folder.  ``add`` takes the rows of a batch (doc_id, k1, k2); ``merged`` gives one row for each key."""

    def __init__(self, fan: int = FAN, folder: str | None = None) -> None:
        self.fan, self.folder, self.levels, self.increments, self.version, self.buckets = fan, folder, [[]], [], 0, 0

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, fan: int = FAN) -> Runs:
        """The runs that earlier calls left in ``folder``."""
        out = cls(fan, folder)
        rows = spark.read.json(f"{folder}/manifest-*").collect()  # a few rows for each batch
        out.version = max(r["version"] for r in rows)
        for r in sorted((r for r in rows if r["version"] == out.version), key=lambda r: (r["level"], r["path"])):
            out.buckets = r["buckets"]
            out._at(r["level"]).append(out._table(spark, r["path"]))
        return out

    def _at(self, level: int) -> list[DataFrame]:
        if level < 0:
            return self.increments
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _table(self, spark: SparkSession, path: str) -> DataFrame:
        """The bucketed table at ``path``, whose buckets Spark knows by a name in the session's catalogue."""
        name = f"line_run_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} (k1 BIGINT, k2 BIGINT, n BIGINT, last BIGINT) USING parquet "
            f"CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        out = spark.table(name)
        out.path, out.table = path, name
        return out

    def _written(self, rows: DataFrame, name: str) -> DataFrame:
        out = self._table(rows.sparkSession, f"{self.folder}/{name}-{uuid.uuid4().hex}")
        rows.select("k1", "k2", "n", "last").repartition(self.buckets, "k1", "k2").sortWithinPartitions("k1", "k2").write.insertInto(out.table)
        return out

    def _record(self, spark: SparkSession) -> None:
        """A new version of the list of runs; the files of an older version stay."""
        self.version += 1
        at = [(level, r.path) for level, runs in enumerate(self.levels) for r in runs] + [(-1, r.path) for r in self.increments]
        rows = [(self.version, level, path, self.buckets) for level, path in at]
        spark.createDataFrame(rows, "version long, level int, path string, buckets int").coalesce(1).write.json(f"{self.folder}/manifest-{self.version}")

    def add(self, batch: DataFrame) -> None:
        spark = batch.sparkSession
        self.folder = self.folder or f"{scratch(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = self.buckets or partitions(spark)
        own = self._written(batch.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "batch")
        runs = self.runs()
        if runs:
            known = [own.join(r.hint("merge"), ["k1", "k2"], "left_semi") for r in runs]
            self.increments.append(self._written(reduce(DataFrame.unionByName, known), "more"))
            own = self._written(self.unseen(own), "keys")
        self._at(0).append(own)
        level = 0
        while len(self._at(level)) >= self.fan:  # compaction: the runs of a level share no key
            full, self.levels[level] = self.levels[level], []
            level += 1
            self._at(level).append(self._written(reduce(DataFrame.unionByName, full), f"keys-{level}"))
        if len(self.increments) >= self.fan:
            self.increments = [self._written(self._summed(), "more")]
        self._record(spark)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds: each run in turn is merge-anti-joined."""
        return reduce(lambda left, r: left.join(r.hint("merge"), ["k1", "k2"], "left_anti"), self.runs(), batch)

    def _summed(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.increments).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def merged(self) -> DataFrame | None:
        """Every key once: its run's row and its increments together."""
        if not self.runs():
            return None
        keys = reduce(DataFrame.unionByName, self.runs())
        if not self.increments:
            return keys
        more = self._summed().select("k1", "k2", F.col("n").alias("more"), F.col("last").alias("later"))
        both = keys.join(more, ["k1", "k2"], "left")
        return both.select("k1", "k2", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))

    def closed(self) -> None:
        """Takes the names of the runs out of the session's catalogue; the files stay."""
        for r in [*self.runs(), *self.increments]:
            r.sparkSession.sql(f"DROP TABLE IF EXISTS {r.table}")


def repeated(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """The lines of all documents, written once, and the keys that lose lines, with ``last``."""
    lines = saved(held(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines")
    runs = Runs()
    for b in range(batches):
        runs.add(lines.filter((F.col("batch") == b) & F.col("first")))
    keys = saved(runs.merged().filter(F.col("n") >= MIN_DOCS).drop("n"), "repeated")
    runs.closed()
    return lines.drop("batch", "first"), keys


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and n_lines (before dropping) and n_dropped."""
    lines, keys = repeated(docs, batches)
    of, x, y, gone, split = fresh(docs, "of", "x", "y", "gone", "split")
    lost = lines.join(keys, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    per_doc = lost.groupBy(F.col("doc_id").alias(of), F.col("x").alias(x)).agg(F.collect_set("pos").alias(gone))  # at most the lines of one document
    df = docs.withColumn(y, _hash())
    df = df.join(per_doc, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(y) == F.col(x)), "left")
    df = df.withColumn(split, F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i))
    kept = F.when(F.col(gone).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return df.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(split).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("text")).alias("kept_sha256"))
