"""SimHash near-dedup with pivot distance tables.

Fingerprints are made per document in Python workers (xxhash and numpy).  Only distinct fingerprints are compared.  For
each a table written once holds its Hamming distances to reference fingerprints (pivots); it also stands for distances
within blocks of bits:

* A reference that differs from another only within a block gives, by the difference of the two distances, the distance
  within that block.  Two fingerprints that differ in at most RADIUS bits differ in no bit of at least
  ``blocks - RADIUS`` blocks, so all their distances within those blocks agree.  The bits of such a choice of blocks stand
  for these distances and are the key by which fingerprints meet: no pair is missed, none is made by a cross join.
* Pairs that meet are discarded if any distance to a whole pivot differs by more than RADIUS, as the triangle inequality
  allows; survivors are verified by counting the bits of their difference.

Within one key the verified pairs are joined into components at once and only the edges of a spanning forest leave the
task, at most one for each row.  A key with more than HOT rows leaves as blocks of rows instead, and each pair of blocks
is one task of bounded size.  Components are then joined over all keys: tasks contract the edges that they read, and
alternating large-star and small-star rounds join what is left.

Defined cases: a null or empty text, or one of white space, has fingerprint zero, linked like any other; a null doc_id
keeps its row and counts after all others when the smallest is sought; repeated rows get equal results; an empty table
gives an empty result; further columns are kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, fresh, partitions, saved

BITS, SEED = 64, 42
#: Rows of one key that one task compares; a block of a larger key.
HOT = 4096
#: Rows of one fingerprint from which they are not brought together, and how many such fingerprints may be broadcast.
HOT_ROWS, HOT_PRINTS = 1000, 1_000_000
#: Edges that a task contracts at once.
CHUNK = 1 << 18
#: Whole reference fingerprints, by a fixed seed.
PIVOTS = np.random.default_rng(20).integers(0, 2**64, size=24, dtype=np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the shingles of ``words`` words of a text, A-Z lower-cased, words split at space and \\x09-\\x0D."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        joined, ends, at = b" ".join(found), [], -1
        for w in found:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        of = xxhash.xxh64_intdigest
        hashes = [of(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
    set_bits, block = np.zeros(BITS, np.int64), 1 << 16
    for k in range(0, len(hashes), block):
        part = np.array(hashes[k : k + block], np.uint64).view(np.uint8)
        set_bits += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def spans_of_blocks(blocks: int) -> list[int]:
    """Masks of ``blocks`` nearly equal blocks of bits."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def masks(radius: int, agree: int) -> list[int]:
    """The choices of ``agree`` blocks, out of ``radius + agree``, of which two near fingerprints share one at least."""
    return [sum(c) for c in combinations(spans_of_blocks(radius + agree), agree)]


def _links(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) are near: pivots first, then the bits themselves."""
    left = np.ones(len(a), bool)
    for k in range(da.shape[0]):
        left &= np.abs(da[k] - db[k]) <= radius
        if k % 8 == 7 and not left.any():
            return left
    left[left] = _ones(a[left] ^ b[left]) <= radius
    return left


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The distances of each fingerprint to each pivot, one row a pivot."""
    return np.stack([_ones(fps ^ p).astype(np.int8) for p in PIVOTS])


def with_distances(fps: DataFrame) -> DataFrame:
    """fp and ``d``, its distances to the pivots, one byte each: computed here, once, for each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _as_column(pivot_table(b.column(0).to_numpy().view(np.uint64)))], ["fp", "d"])

    return fps.select("fp").mapInArrow(run, "fp long, d binary")


def _as_column(table: np.ndarray) -> pa.Array:
    n = table.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * len(PIVOTS), len(PIVOTS), dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(table.T))])


def _as_table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, len(PIVOTS)).T


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows that a pair joins to a smaller one, the smallest row of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            break
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _within(fps: np.ndarray, table: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the near pairs within each run of rows, the runs beginning at ``starts``.

    Rows at distance 1, 2, ... within their run are compared step by step, so no list of pairs is ever held whole.
    """
    n, ends = len(fps), np.append(starts[1:], len(fps))
    end = np.repeat(ends, ends - starts)
    label, rows = np.arange(n), np.arange(n)
    for step in range(1, int((ends - starts).max(initial=0))):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        other = rows + step
        apart = label[rows] != label[other]
        a, b = rows[apart], other[apart]
        near = _links(fps[a], fps[b], table[:, a], table[:, b], radius)
        if near.any():
            low = np.arange(n)
            at, to = _forest(n, np.concatenate([a[near], rows_of(label)]), np.concatenate([b[near], label[rows_of(label)]]))
            low[at] = to
            label = low
            whole = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
            rows = rows[~np.repeat(whole, ends - starts)[rows]]  # runs that are one component already are done
    joined = np.flatnonzero(label != np.arange(n))
    return fps[joined], fps[label[joined]]


def rows_of(label: np.ndarray) -> np.ndarray:
    return np.flatnonzero(label != np.arange(len(label)))


def _across(both: np.ndarray, table: np.ndarray, first: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join near fingerprints of two blocks of bounded size, the first ``first`` rows and the rest: a forest."""
    a, b, left, right = both[:first], both[first:], [], []
    for i in range(len(a)):
        j = np.arange(len(a), len(both))
        near = j[_links(np.broadcast_to(both[i], len(b)), b, table[:, i : i + 1], table[:, j], radius)]
        left.append(np.full(len(near), i))
        right.append(near)
    rows, to = _forest(len(both), np.concatenate([*left, np.empty(0, int)]).astype(int), np.concatenate([*right, np.empty(0, int)]).astype(int))
    return both[rows], both[to]


def _meet(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp, d), sorted by k: edges (u, v), or the rows of a key above HOT as (u=fp, d, k, block)."""

    def out(u, v=None, d=None, k=None, block=None) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        whole = lambda x: none if x is None else pa.array(x.view(np.int64))
        return pa.RecordBatch.from_arrays([whole(u), whole(v), whole(k), whole(block), pa.nulls(len(u), pa.binary()) if d is None else _as_column(d)], ["u", "v", "k", "block", "d"])

    keys, fps, table, done, hot_key = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((len(PIVOTS), 0), np.int8), 0, None
    for b in _with_end(batches):
        if b is not None:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            table = np.concatenate([table, _as_table(b.column(2))], axis=1)
        while len(keys):
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            last = starts[-1] if b is not None else len(keys)  # the last key may go on
            sizes = np.diff(np.append(starts, len(keys)))
            if hot_key is not None and keys[0] != hot_key:
                hot_key, done = None, 0
            if hot_key is None and sizes[0] <= HOT:
                hot = np.flatnonzero(sizes > HOT)
                stop = min(last, starts[hot[0]] if len(hot) else last)
                if stop == 0:
                    break
                inside = starts[starts < stop]
                many = np.repeat(np.diff(np.append(inside, stop)) > 1, np.diff(np.append(inside, stop)))
                k, f = keys[:stop][many], fps[:stop][many]
                if len(k):
                    u, v = _within(f, table[:, :stop][:, many], np.flatnonzero(np.append(True, k[1:] != k[:-1])), radius)
                    if len(u):
                        yield out(u, v)
                keys, fps, table = keys[stop:], fps[stop:], table[:, stop:]
            else:  # a hot key: its rows go out in blocks as they come
                n, hot_key = int(sizes[0]), keys[0]
                yield out(fps[:n], None, table[:, :n], keys[:n], (done + np.arange(n)) // HOT)
                done += n
                keys, fps, table = keys[n:], fps[n:], table[:, n:]
        if b is None:
            return


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_edges(fps: DataFrame, radius: int, agree: int) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within ``radius`` bits, over any number of steps."""
    choices = masks(radius, agree)
    keyed = saved(with_distances(fps), "distances").select("fp", "d", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(choices)])).alias("k"))
    keyed = keyed.select("k", "fp", "d").repartition(partitions(fps.sparkSession), "k").sortWithinPartitions("k", "fp")
    met = saved(keyed.mapInArrow(lambda b: _meet(b, radius), "u long, v long, k long, block long, d binary"), "edges")
    return met.filter(F.col("v").isNotNull()).select("u", "v").unionByName(_hot_edges(met, radius))


def _hot_edges(met: DataFrame, radius: int) -> DataFrame:
    """The blocks of keys above HOT, each pair of blocks compared by a task of its own."""
    rows = met.filter(F.col("block").isNotNull()).select(F.col("u").alias("fp"), "d", "k", "block")
    ends = rows.groupBy("k").agg(F.max("block").alias("end"))
    pairs = rows.join(ends, "k").select("fp", "d", "k", "block", F.explode(F.sequence(F.lit(0).cast("long"), "end")).alias("other"))
    pairs = pairs.select("fp", "d", "k", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def compare(t: pa.Table) -> pa.Table:
        a, b = t["a"][0].as_py(), t["b"][0].as_py()
        order = np.argsort(t["block"].to_numpy(), kind="stable")  # block a first
        f, table = t["fp"].to_numpy().view(np.uint64)[order], _as_table(t["d"].combine_chunks())[:, order]
        u, v = _within(f, table, np.array([0]), radius) if a == b else _across(f, table, int((t["block"].to_numpy() == a).sum()), radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.groupBy("k", "a", "b").applyInArrow(compare, "u long, v long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v): of CHUNK of them at most at once, each node that they join to a smaller one and the smallest it reaches."""
    held, n = [], 0
    for b in _with_end(batches):
        for k in range(0, b.num_rows if b is not None else 0, CHUNK):
            held.append(b.slice(k, CHUNK))
            n += held[-1].num_rows
        while held and (n >= CHUNK or b is None):
            part, n = pa.Table.from_batches(held), max(0, n - CHUNK)
            held = part.slice(CHUNK).to_batches()
            nodes, at = np.unique(np.concatenate([c.to_numpy() for c in part.slice(0, CHUNK).columns]), return_inverse=True)
            rows, to = _forest(len(nodes), *at.reshape(2, -1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array(nodes[to])], ["u", "v"])


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` written, and what each task makes of those it reads: as a rule far fewer, and u > v."""
    return saved(saved(edges.select("u", "v"), "star").mapInArrow(_contract, "u long, v long"), "star")


def _ends(edges: DataFrame) -> tuple[int, int]:
    """Of edges (u, v), how many nodes have several v or are a u and a v, and how many are a u more than once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))).alias("x")).select("x.*")
    of = ends.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.count("to").alias("up"), F.count(F.lit(1)).alias("n"))
    return tuple(of.agg(F.count_if((F.col("a") != F.col("b")) | ((F.col("up") > 0) & (F.col("n") > F.col("up")))), F.count_if(F.col("up") > 1)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that edges (u, v) join to a smaller one; root is the smallest it can reach.

    Each task first contracts the edges it reads.  Alternating large-star and small-star rounds follow, each written to
    the shared folder and contracted again, until only stars are left.  The driver keeps records of every task and plan
    of a job, so what is a forest of stars already takes no round.
    """
    edges = _contracted(edges)
    while (ends := _ends(edges))[0]:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = _contracted(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
    if ends[1]:  # tasks may have made the same edge
        edges = saved(edges.distinct(), "star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def agreeing_blocks(n: int, radius: int) -> int:
    """How many blocks must agree, so that chance meetings stay few for n fingerprints: more blocks, longer keys.

    Every choice is exact; the number only sets how many keys a fingerprint has and how many others share one.
    """
    agree = 2
    while BITS * agree // (radius + agree) < max(17, math.log2(n + 1) - 1):
        agree += 1
    return agree


def groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links, for each row of ``docs``."""
    rows = saved(fingerprints(docs, words), "fingerprints")
    reps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    edges = near_edges(reps.select("fp"), radius, agreeing_blocks(reps.count(), radius))
    return named(rows, reps, components(edges)).select("doc_id", "fp", "component_id")


def named(rows: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with fp) and their component_id, from ``reps`` (fp, rep, n) and components (node, root).

    Rows of a fingerprint that more than HOT_ROWS share are not brought together: such fingerprints are at most one for
    HOT_ROWS rows, and are broadcast if there are no more than HOT_PRINTS; beyond that Spark splits skewed partitions.
    """
    whole = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp").join(reps, "fp")
    low = whole.groupBy("root").agg(F.min("rep").alias("low"))
    moved = whole.join(low, "root").select("fp", "low")
    names = saved(reps.join(moved, "fp", "left").select("fp", "n", F.coalesce("low", "rep").alias("component_id")), "names")
    hot = names.filter(F.col("n") > HOT_ROWS).select("fp", "component_id")
    if not 0 < hot.count() <= HOT_PRINTS:
        return rows.join(names.drop("n"), "fp")
    few = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(names.filter(F.col("n") <= HOT_ROWS).drop("n"), "fp")
    return rows.join(F.broadcast(hot), "fp").unionByName(few)


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, one of each group of near copies.

    Near copies are those of :mod:`corvane.llm.nearcopies`, five-word shingle sets of similarity 0.8 or more.
    Rows that share the smallest doc_id all stay; rows without a doc_id stay only if their whole component has none.
    """
    from corvane.llm import nearcopies

    (of,) = fresh(docs, "of")
    kept = nearcopies.groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(of)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")
