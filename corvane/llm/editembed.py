"""Document fingerprints by randomised edit embedding.

A walker goes over the characters of a text: at step j it stands on a character and moves on by the bit that a random
word W[j], shared by all texts, holds for that character.  What it stands on at each step is the embedding: texts that
differ by few edits soon stand on the same characters again, so edit distance becomes Hamming distance of embeddings.

A fingerprint samples SLOTS places of the embedding.  A slot draws, from a fixed seed, a sequence of steps that a text of
ever greater length would choose (each the least of all hashes so far), and keeps what the walker stood on at the last
of them that it reached: one byte of a hash of GRAM characters.  So the places are shared by texts of all lengths, no
text is cut, and two fingerprints agree in about the share of the embedding that agrees.  Bands of BAND slots are the
keys under which likely near texts meet; survivors are verified by the share of all slots that agree.

Defined cases: a null or empty text has the fingerprint of zeros, alike only to itself (likeness 1); texts of any length
are walked whole, short ones side by side in numpy and long ones alone; a null doc_id sorts last among the ids; repeated
ids are next to each other in the order of their texts' hashes; with a single document the next document is the document
itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, partitions, saved
from corvane.llm.simhash import components, named

SLOTS, GRAM, BAND, SEED = 64, 4, 4, 11
#: Likeness from which two texts are of one class.  Of texts within an edit distance of 0.2 % of their length (one edit at least),
#: nine in ten and more agree so far; the walk of the others falls out of step, as slots past an edit agree only once it is back in step.
LEAST = 0.65
#: Fingerprints of one band that are compared as rows of a join; of a larger band, fingerprints in a block.
SMALL, BLOCK = 32, 512
PERIOD = 1 << 16
#: Texts walked side by side: so many code points at once, until fewer than ALONE still walk.
SIDE_BY_SIDE, ALONE = 4 << 20, 48

_words = np.random.default_rng(SEED).integers(-(2**63), 2**63, size=PERIOD, dtype=np.int64)
_word_list = _words.tolist()


def _sample_steps() -> tuple[np.ndarray, np.ndarray]:
    """Steps and slots at which a slot takes a new sample, by step: the record minima of one random sequence a slot."""
    r, steps, slots = np.random.default_rng(SEED + 1), [], []
    for s in range(SLOTS):
        j, least = 0, float(r.random())
        while j < 1 << 40:
            steps.append(j)
            slots.append(s)
            j += int(r.geometric(max(least, 1e-15)))
            least *= float(r.random())
    order = np.lexsort((slots, steps))
    return np.array(steps)[order], np.array(slots)[order]


_steps, _slots = _sample_steps()


def _events() -> list[tuple[int, np.ndarray]]:
    at, first = np.unique(_steps, return_index=True)
    return list(zip(at.tolist(), np.split(_slots, first[1:]), strict=True))


_at_step = _events()


def _byte(code: np.ndarray | int, slot: np.ndarray) -> np.ndarray:
    """One byte, 1 to 255, for a hash of characters and a slot."""
    h = (np.asarray(code, np.uint64) ^ (np.asarray(slot, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def _walk(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprints, one row each, of the texts codes[starts[i]:ends[i]]."""
    out = np.zeros((len(starts), SLOTS), np.uint8)
    side = ((codes.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int8)  # which bit of a word a character reads
    gram = codes.astype(np.uint64)
    padded = np.append(gram, np.zeros(GRAM, np.uint64))

    def code_at(pos: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = np.zeros(len(pos), np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0x100000001B3) + np.where(pos + k < end, padded[np.minimum(pos + k, len(padded) - 1)] + np.uint64(1), np.uint64(0))
        return h

    live = np.flatnonzero(ends > starts)
    pos, end, j, event = starts[live].astype(np.int64), ends[live].astype(np.int64), 0, 0
    side = np.append(side, np.int8(0))
    while len(live) >= ALONE:
        stop = _at_step[event][0]
        while j < stop:
            for _ in range(min(stop - j, 32)):
                pos += (_words[j % PERIOD] >> side[pos]) & 1
                np.minimum(pos, end, out=pos)
                j += 1
            going = pos < end
            if not going.all():
                live, pos, end = live[going], pos[going], end[going]
                if len(live) < ALONE:
                    break
        if j < stop or not len(live):
            break
        code = code_at(pos, end)
        for s in _at_step[event][1]:
            out[live, s] = _byte(code, s)
        event += 1
    for i, p, e in zip(live.tolist(), pos.tolist(), end.tolist(), strict=True):
        _walk_alone(out[i], codes, side, p, e, j, event, code_at)
    return out


def _walk_alone(row: np.ndarray, codes: np.ndarray, side: np.ndarray, pos: int, end: int, j: int, event: int, code_at) -> None:
    """One walker from step j on; its text is read in blocks, as a list of small ints is faster than an array here."""
    low = pos
    bits = side[low : low + PERIOD].tolist()
    while pos < end:
        stop = _at_step[event][0]
        while j < stop and pos < end:
            n = min(stop - j, PERIOD - j % PERIOD, end - pos)
            if pos - low + n > len(bits):
                low = pos
                bits = side[low : low + max(n, PERIOD)].tolist()
            p = pos - low
            for w in _word_list[j % PERIOD : j % PERIOD + n]:
                p += (w >> bits[p]) & 1
            pos, j = p + low, j + n
        if pos >= end:
            return
        code = code_at(np.array([pos]), np.array([end]))
        for s in _at_step[event][1]:
            row[s] = _byte(code, s)[0]
        event += 1


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of SLOTS bytes for each text."""
    out, order = np.zeros((len(texts), SLOTS), np.uint8), sorted(range(len(texts)), key=lambda i: len(texts[i]))
    k = 0
    while k < len(order):
        j, size = k, 0
        while j < len(order) and (j == k or size + len(texts[order[j]]) <= SIDE_BY_SIDE):
            size += len(texts[order[j]])
            j += 1
        part = [texts[i] for i in order[k:j]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in part])
        out[order[k:j]] = _walk(codes, ends - [len(t) for t in part], ends)
        k = j
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of slots that agree, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ordered(docs: DataFrame) -> DataFrame:
    """(part, id, x, packed, own): each part holds a stretch of the documents by descending id, and at its end, with own
    false, the document after it.  Ids alone are looked at to cut the stretches; texts move once, each packed by zstd."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("x"), F.coalesce("text", F.lit("")).alias("text"))
    ids = saved(docs.select(F.col("doc_id").cast("long").alias("id")), "ids")
    n = partitions(spark)
    cuts = sorted(set(ids.filter("id is not null").approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n)))  # as many numbers as partitions
    cuts = [int(c) for c in cuts]

    def part(c):
        # descending: the largest ids are in part 0, null ids in the last one
        above = F.filter(F.array(*[F.lit(k).cast("long") for k in cuts]), lambda k: k >= c) if cuts else F.array()
        return F.when(c.isNull(), F.lit(len(cuts))).otherwise(F.size(above)).cast("int")

    heads = ids.groupBy(part(F.col("id")).alias("part")).agg(F.max("id").alias("head")).orderBy("part").collect()  # one row a part
    if not heads:
        return _packed(base.select(F.lit(0).alias("part"), "*", F.lit(True).alias("own")))
    before = {h["head"]: heads[k - 1]["part"] for k, h in enumerate(heads)}  # before the first stretch comes the last
    known = {h: p for h, p in before.items() if h is not None}
    lead = F.element_at(F.create_map(*[v for h, p in known.items() for v in (F.lit(h).cast("long"), F.lit(p))]), F.col("id")) if known else F.lit(None)
    lead = F.when(F.col("id").isNull(), F.lit(before.get(None))).otherwise(lead).cast("int")
    rows = base.withColumn("part", part(F.col("id"))).withColumn("own", F.lit(True))
    heads_only = base.filter(F.col("id").isin(list(known)) | (F.col("id").isNull() if None in before else F.lit(False)))
    extra = heads_only.withColumn("part", lead).withColumn("own", F.lit(False))
    both = rows.select("part", "id", "x", "text", "own").unionByName(extra.select("part", "id", "x", "text", "own"))
    return _packed(both).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(F.col("part"), F.desc("own"), F.desc_nulls_last("id"), "x")


def _packed(rows: DataFrame) -> DataFrame:
    """(part, id, x, packed, own): the texts as zstd frames of their UTF-8, about two thirds of what the shuffle's own codec writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            frames = pa.array([pack(t) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("part", "id", "x")), frames, b.column("own")], ["part", "id", "x", "packed", "own"])

    rows = rows.select("part", "id", "x", F.col("text").cast("binary").alias("text"), "own")
    return rows.mapInArrow(run, "part int, id long, x long, packed binary, own boolean")


def _pairs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """(id, text, following text) for each own row of a stretch; of the rows after the stretch the first one counts."""
    last = None
    for part, i, text, own in rows:
        if last is not None and last[0] == part and last[3]:
            yield last[1], last[2], text
        last = (part, i, text, own)


def report(docs: DataFrame) -> DataFrame:
    """The fingerprints of each text and its edited text, their likeness, and class_id, the class of near texts."""
    rows = classes(saved(described(docs), "described"))
    return rows.select("doc_id", "n_chars", *[F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], "near_edited", "near_next", "class_id")


def described(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        packed = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("part", "id", "packed", "own")), strict=True))
        rows = ((part, i, unpack(frame).decode(), own) for part, i, frame, own in packed)
        held: list[tuple] = []
        size = 0
        for t in _pairs(rows):
            held.append(t)
            size += len(t[1])
            if size > SIDE_BY_SIDE:
                yield _described(held)
                held, size = [], 0
        if held:
            yield _described(held)

    return _ordered(docs).mapInArrow(run, schema)


def _described(held: list[tuple]) -> pa.RecordBatch:
    """The result rows of consecutive documents; the text after the last is walked too."""
    new = [edited(t, f) for _, t, f in held]
    prints = fingerprints([t for _, t, _ in held] + [held[-1][2]])
    own, after, made = prints[:-1], prints[1:], fingerprints(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in held], pa.int64()),
            pa.array([len(t) for _, t, _ in held], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in new], pa.binary()),
            pa.array([r.tobytes() for r in own], pa.binary()),
            pa.array([r.tobytes() for r in made], pa.binary()),
            pa.array(likeness(own, made)),
            pa.array(likeness(own, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _alike(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) of fingerprint numbers whose fingerprints agree in at least ``least`` of the slots."""
    both = pairs.join(prints.select(F.col("fp").alias("u"), F.col("p").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("p").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(likeness(x, y) >= least, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp), sorted: those that are not the first of their k, with the first; read as a stream, no k is held."""
    last, low = None, None
    for b in batches:
        if not b.num_rows:
            continue
        k, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        first = np.append(last is None or k[0] != last, k[1:] != k[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
        lows = np.where(at < 0, 0 if low is None else low, fp[at])
        last, low = k[-1], lows[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[~first]) for x in (k, fp, lows)], ["k", "fp", "low"])


def links(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``prints`` (fp, p: its number and bytes) that meet in a band and agree in at
    least ``least`` of the slots, over any number of steps.

    Each band first links its fingerprints to the smallest one.  Only bands whose fingerprints are not in one component
    then compare the rest: up to SMALL of them as rows of a join, more as pairs of blocks, each a task of its own, which passes on a
    spanning forest of the components that it joins rather than all pairs.
    """
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("p", BAND * k + 1, BAND)) for k in range(SLOTS // BAND)])
    keyed = prints.select(F.explode(bands).alias("k"), "fp").repartition(partitions(prints.sparkSession), "k").sortWithinPartitions("k", "fp")
    met = saved(keyed.mapInArrow(_runs, "k long, fp long, low long"), "bands")
    shared = met.unionByName(met.select("k", F.col("low").alias("fp"), "low").distinct())
    shared = shared.join(met.groupBy("k").agg((F.count(F.lit(1)) + 1).alias("n")), "k")
    stars = saved(_alike(met.select(F.col("low").alias("u"), F.col("fp").alias("v")).distinct(), prints, least), "stars")
    found = components(stars).select(F.col("node").alias("fp"), "root")
    placed = shared.join(found, "fp", "left").select("k", "fp", "n", F.coalesce("root", "fp").alias("c"))
    split = placed.groupBy("k").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("k")
    left = saved(placed.join(split, "k"), "open")
    few = left.filter(F.col("n") <= SMALL)
    pairs = few.select("k", F.col("fp").alias("u"), F.col("c").alias("cu")).join(few.select("k", F.col("fp").alias("v"), F.col("c").alias("cv")), "k").filter("u < v and cu <> cv")
    more = _alike(pairs.select("u", "v").distinct(), prints, least)
    many = left.filter(F.col("n") > SMALL).withColumn("blocks", F.floor((F.col("n") - 1) / BLOCK) + 1).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    many = many.select("k", "fp", "c", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    many = many.select("k", "fp", "c", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).join(prints, "fp")

    def compare(t: pa.Table) -> pa.Table:
        block, a, b = t["block"].to_numpy(), t["a"][0].as_py(), t["b"][0].as_py()
        p, fp, c = np.frombuffer(b"".join(t["p"].to_pylist()), np.uint8).reshape(-1, SLOTS), t["fp"].to_numpy(), t["c"].to_numpy()
        others, u, v, joined = np.flatnonzero(block == b), [], [], {}

        def root(x: int) -> int:
            while (y := joined.get(x, x)) != x:
                joined[x] = joined.get(y, y)
                x = y
            return x

        for i in np.flatnonzero(block == a).tolist():
            near = others[(c[others] != c[i]) & (likeness(p[others], p[i]) >= least)]
            of, first = np.unique(c[near], return_index=True)
            for other, k in zip(of.tolist(), near[first].tolist(), strict=True):
                x, y = root(int(c[i])), root(other)
                if x != y:  # one link for each two components that it joins
                    joined[max(x, y)] = min(x, y)
                    u.append(fp[i])
                    v.append(fp[k])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return stars.unionByName(more).unionByName(many.groupBy("k", "a", "b").applyInArrow(compare, "u long, v long"))


def classes(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``rows`` (doc_id, fingerprint as bytes, ...) with class_id: the smallest doc_id reachable by links between fingerprints.

    With 16 bands, two fingerprints that agree in 0.65 of the slots miss each other with a chance of 0.04, in 0.8 with 0.0002.  Equal
    fingerprints are one here, so groups of copies never meet in pairs.  Fingerprints are told apart by 64 bits of hash.
    """
    rows = rows.withColumn("fp", F.xxhash64("fingerprint"))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("fingerprint").alias("p"))
    prints = saved(prints, "prints")
    found = components(links(prints.select("fp", "p"), least))
    return named(rows, prints.select("fp", "rep", "n"), found).withColumnRenamed("component_id", "class_id").drop("fp")
