"""Near copies by SimHash with pivot distance tables over five-word shingle sets; the texts decide.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is LEAST or more.  Every link is
verified on the texts.  At similarity 0.8 a 64-bit SimHash differs in 9.6 places on average, in up to 19 for one pair of a
thousand, so the fingerprint here has BITS bits and the pivots serve in two ways:

* A table holds, for each of GROUPS groups of PIVOTS random references, which of them is nearest to a text or, by its
  complement, farthest: the distance is the number of bits in which the hashes of all shingles differ from the reference.
  Two texts of similarity 0.8 agree in 0.41 of the groups, unlike ones in one of 256.  KEYS keys of three groups each bring
  texts together: of 30,000 simulated pairs of similarity 0.8 they missed none, keys of four groups, which take over
  from 4 million texts, 16.
* The texts of a key are placed by their distance to its smallest fingerprint, the pivot of that key.  Where no distance
  falls into a gap of more than RADIUS bits, the triangle inequality parts the key into cells that share no near pair, and
  within a cell it discards pairs.  The bits of the whole fingerprints discard what is left beyond RADIUS: texts of
  similarity 0.8 differ in at most 0.19 of the bits on average (five shingles against four), RADIUS is 5.4 deviations more.

Fingerprints within RADIUS of each other form groups, over any number of steps; only they can hold near copies.  A text is
first linked to two of the pivots within RADIUS that its keys have, the smallest and the nearest.  Only cells whose texts are
not in one group then, compare all pairs across groups: cells of up to SMALL texts as rows of a join, larger ones as pairs of
blocks of bounded size, each a task of its own.  So a large group of like texts costs two links for each text.

The texts of a group then meet once, whatever the number of keys that they share, and the sets of shingles of all its pairs
are compared by a product of matrices.  In a group of more than BLOCK texts those links to pivots are held against the texts
first, and only blocks of texts that these have not joined are compared, each pair of blocks a task of its own; of its links a
forest leaves the task.  So no pair that could join components is left out, and pairs of one group are not rows of a table;
but a text that no link joins goes to each pair of blocks of its group, one row for BLOCK others.
Texts of the same words (by a 64-bit hash) are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, partitions, saved
from corvane.llm.simhash import HOT_PRINTS, SEED, _forest, components, named

WORDS, LEAST = 5, 0.8
BITS, RADIUS = 512, 144
#: One byte names a pivot of a group or its complement.
GROUPS, PIVOTS, KEYS = 192, 128, 192
#: Texts of one cell that are compared as rows of a join; of a larger cell or group, texts in a block.
SMALL, BLOCK = 32, 256
#: Shingles of a product of matrices.
WIDE = 8192
_RANDOM = np.random.default_rng(21)
_XOR = _RANDOM.integers(0, 2**64, size=BITS // 64, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, size=BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, A-Z lower-cased; a text of fewer words is one shingle."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    of = xxhash.xxh64_intdigest
    return np.unique(np.array([of(b" ".join(found[i : i + words]), SEED) for i in range(max(1, len(found) - words + 1))], np.uint64))


def leads(of: np.ndarray) -> np.ndarray:
    """For each bit, by how many the shingles whose hash has it set outnumber the others."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(of), 4096):
        x = (of[k : k + 4096, None] ^ _XOR) * _TIMES
        x ^= x >> np.uint64(32)
        x *= _TIMES
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * ones - len(of)


def prints(lead: np.ndarray) -> np.ndarray:
    """Rows of leads as SimHash fingerprints of BITS // 64 words: a bit is set if it is in over half of the hashes."""
    return np.packbits(lead > 0, axis=-1, bitorder="little").view("<i8")


@lru_cache(1)
def references() -> np.ndarray:
    """All pivots, one a column: 1 for a bit that is set, else -1."""
    return np.random.default_rng(20).integers(0, 2, size=(BITS, GROUPS * PIVOTS), dtype=np.int8).astype(np.float32) * 2 - 1


def nearest(lead: np.ndarray) -> np.ndarray:
    """For rows of leads, one byte for each group: the pivot that is nearest, or 128 and the one that is farthest.

    All shingles of a text together differ from a pivot in (BITS * shingles - lead @ pivot) / 2 bits.
    """
    out = np.empty((len(lead), GROUPS), np.uint8)
    for k in range(0, len(lead), 256):
        near = (lead[k : k + 256].astype(np.float32) @ references()).reshape(-1, GROUPS, PIVOTS)
        high, low = near.argmax(axis=2)[..., None], near.argmin(axis=2)[..., None]
        far = -np.take_along_axis(near, low, 2) > np.take_along_axis(near, high, 2)
        out[k : k + 256] = np.where(far, low + PIVOTS, high)[..., 0]
    return out


def groups_of_a_key(n: int) -> int:
    """How many groups must agree, so that chance meetings stay few for n texts: more groups, more keys."""
    return max(3, math.ceil((math.log2(n + 1) + 2) / 8))


@lru_cache(8)
def choices(groups: int) -> np.ndarray:
    """The groups of each key, every group in about as many keys: KEYS keys of three groups, 2.5 times as many for one more."""
    rng, of = np.random.default_rng(groups), GROUPS // groups
    rounds = math.ceil(KEYS * 2.5 ** (groups - 3) / of)
    return np.concatenate([rng.permutation(GROUPS)[: groups * of].reshape(of, groups) for _ in range(rounds)])


def keys(near: np.ndarray, groups: int = 3) -> np.ndarray:
    """Rows of nearest pivots as rows of keys, each of its number and the pivots of ``groups`` groups (a hash if more than three)."""
    out = np.arange(len(choices(groups)), dtype=np.uint64) + np.zeros((len(near), 1), np.uint64)
    for of in choices(groups).T:
        out = out * np.uint64(256) + near[:, of]
        if groups > 3:
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _words(text: str | None) -> int:
    """A signed 64-bit hash of the words of a text."""
    import xxhash

    of = xxhash.xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))
    return of - (1 << 64) if of >> 63 else of


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, fp (of the words), print and near, the pivots, for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                texts = [t.as_py() for t in b.column(1)[k : k + 1024]]
                lead = np.stack([leads(shingles(t)) for t in texts])
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * (BITS // 64), pa.int32()), pa.array(prints(lead).reshape(-1)))
                near = pa.array([x.tobytes() for x in nearest(lead)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1024], pa.array([_words(t) for t in texts], pa.int64()), words, near], ["doc_id", "fp", "print", "near"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, print array<long>, near binary")


def _texts(docs: DataFrame, fps: DataFrame) -> DataFrame:
    """fp and text of those rows of ``docs`` whose fp is in ``fps``, one of each.

    Up to HOT_PRINTS fps are broadcast, so that other texts are not shuffled; beyond that all texts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_words(t.as_py()) for t in b.column(0)], pa.int64()), b.column(0)], ["fp", "text"])

    fps = F.broadcast(fps) if fps.count() <= HOT_PRINTS else fps
    return docs.select("text").mapInArrow(run, "fp long, text string").join(fps, "fp", "left_semi").groupBy("fp").agg(F.any_value("text").alias("text"))


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, fp), sorted, those whose key another row has, and ``low``, the smallest fp of the key."""

    def out(k, f, low, keep) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k, f, low)], ["k", "fp", "low"])

    held, joined = np.empty((3, 0), np.int64), False  # the last row waits for the next batch
    for b in batches:
        if not b.num_rows:
            continue
        k, f = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns))
        same = k[1:] == k[:-1]
        before, after = np.append(joined, same), np.append(same, False)
        low = f[np.maximum.accumulate(np.where(before, 0, np.arange(len(k))))]
        if joined:
            low[: np.argmin(np.append(before, False))] = held[2, 0]
        yield out(k[:-1], f[:-1], low[:-1], (before | after)[:-1])
        held, joined = np.stack([k[-1:], f[-1:], low[-1:]]), bool(before[-1])
    yield out(*held, np.full(held.shape[1], joined))


def _shared(reps: DataFrame) -> DataFrame:
    """k, fp and low for each key that several fingerprints (fp, near) have."""
    agree = groups_of_a_key(reps.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                near = np.frombuffer(b"".join(b.column(1)[k : k + 1024].to_pylist()), np.uint8).reshape(-1, GROUPS)
                fps = b.column(0)[k : k + 1024].to_numpy()
                ks = keys(near, agree)
                yield pa.RecordBatch.from_arrays([pa.array(ks.reshape(-1)), pa.array(np.repeat(fps, ks.shape[1]))], ["k", "fp"])

    keyed = reps.select("fp", "near").mapInArrow(run, "k long, fp long")
    keyed = keyed.repartition(partitions(reps.sparkSession), "k").sortWithinPartitions("k", "fp")
    return keyed.mapInArrow(_meeting, "k long, fp long, low long")


def _bits(a: str, b: str) -> Column:
    """The number of bits in which two columns of fingerprints differ."""
    return sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64))


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose fingerprints differ in at most RADIUS bits."""
    both = pairs.join(reps.select(F.col("fp").alias("u"), F.col("print").alias("a")), "u").join(reps.select(F.col("fp").alias("v"), F.col("print").alias("b")), "v")
    return both.filter(_bits("a", "b") <= RADIUS).select("u", "v")


def _cells(table: DataFrame) -> DataFrame:
    """``table`` (k, fp, d) with ``cell``: texts of a key that a gap of more than RADIUS in d parts are in two cells.

    d is the distance to one pivot, so texts on two sides of such a gap differ in more than RADIUS bits.
    """
    of = Window.partitionBy("k").orderBy("d")  # a key has at most BITS + 1 distances
    steps = table.select("k", "d").distinct().withColumn("gap", F.col("d") - F.coalesce(F.lag("d").over(of), F.col("d")) > RADIUS)
    steps = steps.select("k", "d", F.sum(F.col("gap").cast("int")).over(of).alias("cell"))
    return table.join(steps, ["k", "d"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are near copies by their texts."""
    both = pairs.join(texts.select(F.col("fp").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("fp").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(8)(shingles)  # texts of many pairs come one after another
        for b in batches:
            near = [similarity(of(x.as_py()), of(y.as_py())) >= LEAST for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _compare(t: pd.DataFrame) -> pd.DataFrame:
    """Links across the groups of one pair of blocks by fingerprints; texts that a link joined are not compared again."""
    a, b = int(t["a"].iloc[0]), int(t["b"].iloc[0])
    block, fps, d, bits = t["block"].to_numpy(), t["fp"].to_numpy(), t["d"].to_numpy(), np.stack(t["print"].to_numpy()).view(np.uint64)
    label, out, second = t["c"].to_numpy().copy(), [], np.flatnonzero(block == b)
    for i in np.flatnonzero(block == a):
        j = second[(label[second] != label[i]) & (np.abs(d[second] - d[i]) <= RADIUS)]
        for j in j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= RADIUS]:
            if label[i] != label[j]:
                out.append((fps[i], fps[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _shared_shingles(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets ``first`` has in common with each of ``second``; nothing is said of a set and itself."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    often = times[at] > 1
    rows, at = rows[often], (np.cumsum(times > 1) - 1)[at[often]]
    order = np.argsort(at, kind="stable")
    rows, at, both = rows[order], at[order], np.zeros((len(first), len(second)))
    for start in range(0, int((times > 1).sum()), WIDE):
        part, of = slice(*np.searchsorted(at, [start, start + WIDE])), np.zeros((len(sets), WIDE), np.float32)
        of[rows[part], at[part] - start] = 1
        of = of[:, : at[part].max() - start + 1]
        both += of[first] @ of[second].T
    return both


def _linked(t: pd.DataFrame) -> pd.DataFrame:
    """A forest of the near copies, by their texts, across the components of one pair of blocks."""
    a, b = t["a"].iloc[0], t["b"].iloc[0]
    first, second = np.flatnonzero(t["block"] == a), np.flatnonzero(t["block"] == b)
    fps, c, sets = t["fp"].to_numpy(), t["c"].to_numpy(), [shingles(x) for x in t["text"]]
    both, n = _shared_shingles(sets, first, second), np.array([len(x) for x in sets])
    near = both / np.maximum(n[first][:, None] + n[second] - both, 1) >= LEAST
    i, j = np.nonzero(near & (c[first][:, None] != c[second]))
    rows, to = _forest(len(t), first[i], second[j])
    return pd.DataFrame({"u": fps[rows], "v": fps[to]})


def _groups_of_prints(reps: DataFrame, first: DataFrame, table: DataFrame) -> DataFrame:
    """fp and g of each fingerprint that steps of at most RADIUS bits, among those that share a key, join to another."""
    found = components(first).select(F.col("node").alias("fp"), "root")
    placed = saved(_cells(table.drop("low")).join(found, "fp", "left").select("k", "cell", "fp", "d", F.coalesce("root", "fp").alias("c")), "placed")
    split = placed.groupBy("k", "cell").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("n")).filter("c1 <> c2")
    left = saved(placed.join(split.select("k", "cell", "n"), ["k", "cell"]), "open")
    few = left.filter(F.col("n") <= SMALL)
    pairs = few.select("k", "cell", F.col("fp").alias("u"), F.col("c").alias("cu"), F.col("d").alias("du")).join(few.select("k", "cell", F.col("fp").alias("v"), F.col("c").alias("cv"), F.col("d").alias("dv")), ["k", "cell"])
    pairs = pairs.filter((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & (F.abs(F.col("du") - F.col("dv")) <= RADIUS)).select("u", "v").distinct()
    second = saved(_near(pairs, reps), "second")
    many = left.filter(F.col("n") > SMALL).withColumn("blocks", F.floor((F.col("n") - 1) / BLOCK) + 1).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    many = many.select("k", "cell", "fp", "c", "d", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    many = many.select("k", "cell", "fp", "c", "d", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).join(reps.select("fp", "print"), "fp")
    third = many.groupBy("k", "cell", "a", "b").applyInPandas(_compare, "u long, v long")
    found = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")).unionByName(second).unionByName(third)).select(F.col("node").alias("fp"), F.col("root").alias("g"))
    return found.unionByName(found.select(F.col("g").alias("fp"), "g").distinct())


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (g, fp, c) of large groups with a, b and block, once for each pair (a, b) of blocks that ``block`` is in.

    A component c of more than BLOCK rows has blocks of its own, which are not paired with each other.
    """
    large = rows.groupBy("g", "c").count().filter(F.col("count") > BLOCK).select("g", "c", F.col("c").alias("own"))
    rows = rows.join(F.broadcast(large), ["g", "c"], "left")  # at most one row for BLOCK rows, as the next
    blocks = rows.groupBy("g", "own").agg((F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1).alias("blocks"))
    dealt = rows.join(F.broadcast(blocks.withColumnsRenamed({"g": "h", "own": "o"})), F.col("g").eqNullSafe(F.col("h")) & F.col("own").eqNullSafe(F.col("o")))
    dealt = dealt.select("g", "fp", "c", F.concat_ws(":", "own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).alias("block"))
    each = blocks.select("g", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at")).select("g", "own", F.concat_ws(":", "own", "at").alias("a"))
    pairs = each.join(each.select("g", F.col("own").alias("other"), F.col("a").alias("b")), "g").filter("a <= b and (own is null or other is null or own <> other)")
    return dealt.join(pairs.select("g", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")), ["g", "block"])


def edges(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) that join all near copies of ``docs`` by their texts, over any number of steps; ``reps``: fp, print, near."""
    shared, of = saved(_shared(reps), "shared"), reps.select("fp", "print")
    table = shared.join(of, "fp").join(of.select(F.col("fp").alias("low"), F.col("print").alias("pivot")), "low")
    table = saved(table.select("k", "fp", "low", _bits("print", "pivot").alias("d")), "distances")
    links = table.filter((F.col("fp") != F.col("low")) & (F.col("d") <= RADIUS)).groupBy("fp").agg(F.min("low").alias("a"), F.min(F.struct("d", "low")).alias("b"))
    first = saved(links.select(F.explode(F.array_distinct(F.array("a", "b.low"))).alias("u"), F.col("fp").alias("v")), "first")
    member = saved(_groups_of_prints(reps, first, table), "members")
    large = F.broadcast(member.groupBy("g").count().filter(F.col("count") > BLOCK).select("g"))  # at most one row for BLOCK texts
    few, many = member.join(large, "g", "left_anti"), saved(member.join(large, "g", "left_semi"), "many")
    texts = saved(_texts(docs, member.select("fp")), "texts")
    stars = saved(_verified(first.join(many.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v"), texts), "stars")
    found = components(stars).select(F.col("node").alias("fp"), "root")
    many = saved(many.join(found, "fp", "left").select("g", "fp", F.coalesce("root", "fp").alias("c")), "joined")
    tasks = few.select("g", "fp", F.col("fp").alias("c"), *(F.lit("").alias(x) for x in ("block", "a", "b"))).unionByName(_in_blocks(many))
    stars = found.select(F.col("fp").alias("u"), F.col("root").alias("v"))  # as good as the links that it comes from
    return stars.unionByName(tasks.join(texts, "fp").groupBy("g", "a", "b").applyInPandas(_linked, "u long, v long"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links, for each row of ``docs``."""
    rows = saved(_described(docs), "described")
    reps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("print").alias("print"), F.any_value("near").alias("near")), "distinct")
    return named(rows.select("doc_id", "fp"), reps.select("fp", "rep", "n"), components(edges(docs, reps))).select("doc_id", "fp", "component_id")
