"""Packing into windows of WINDOW tokens by non-negative least squares.

A document of n tokens gives n // WINDOW whole windows and one rest.  Of the rests only the histogram of lengths (at most
WINDOW - 1 rows, whatever the input) comes to the driver.  There :func:`plan` enumerates all combinations of one, two or
three length classes that fill a window, solves how often to repeat each against the histogram of classes by non-negative
least squares, rounds down, and packs what is left greedily, again by lengths: the largest that fits goes in, and the
same filling is repeated as often as the counts allow.  The plan says which of the rests of a length, by number, go to
which window, so that tasks place pieces without meeting.  Numbers within a length come from prefix sums over chunks;
no task holds all rests of one length.

Defined cases: a null or empty text is the one id END; a null doc_id is carried through; repeated rows are packed each for
itself; an empty table gives an empty result; further columns are ignored.  A window that is not full is padded to
WINDOW by whoever writes it, unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, gapless, saved
from corvane.llm.wordcache import word_ids

WINDOW, END = 2048, 1
#: Lengths are planned in classes of so many tokens.
WIDTH = 8


def combinations(units: int) -> list[tuple[int, ...]]:
    """The ways to write ``units`` as one, two or three classes, smallest first."""
    out = [(units,), *((a, units - a) for a in range(1, units // 2 + 1))]
    return out + [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x of no negative entry that makes |a x - b| least, by the active-set method."""
    x, passive, tried = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool), 0
    gradient = a.T @ b
    while tried < 3 * a.shape[0] and (~passive).any() and gradient[~passive].max() > tolerance:
        tried += 1
        passive[np.argmax(np.where(passive, -np.inf, gradient))] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                break
            low = passive & (s <= 0)
            step = np.min(x[low] / (x[low] - s[low]))
            x += step * (s - x)
            passive &= x > tolerance
            x[~passive] = 0
        x = s
        gradient = a.T @ (b - a @ x)
    return x


@dataclass
class Plan:
    """Where rest number k of a length goes: ``ranges[length]`` lists (first k, how many, first window, rests a window)."""

    ranges: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    windows: int = 0

    def give(self, length: int, first: int, many: int, window: int, each: int = 1) -> None:
        if many:
            self.ranges.setdefault(length, []).append((first, many, window, each))

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.array(sorted(v), np.int64) for k, v in self.ranges.items()}


def plan(histogram: dict[int, int], window: int = WINDOW, width: int = WIDTH) -> Plan:
    """Places for histogram[length] rests of each length below ``window``."""
    out, units = Plan(), window // width
    left = {n: c for n, c in sorted(histogram.items()) if c and n < window}
    given = dict.fromkeys(left, 0)
    classes: dict[int, list[int]] = {}
    for n in left:
        classes.setdefault(-(-n // width), []).append(n)
    if classes:
        target = np.zeros(units)
        for u, lengths in classes.items():
            target[u - 1] = sum(left[n] for n in lengths)
        ways = [w for w in combinations(units) if all(u in classes for u in w)]
        a = np.zeros((units, len(ways)))
        for k, w in enumerate(ways):
            for u in w:
                a[u - 1, k] += 1
        scale = target.max()
        x = nnls(a, target / scale) * scale if ways else np.zeros(0)
        free = target.astype(int)
        for k in np.argsort(-x, kind="stable"):
            need = a[:, k].astype(int)
            times = min(int(x[k] + 1e-6), int((free[need > 0] // need[need > 0]).min()))
            if times <= 0:
                continue
            for u in ways[k]:
                at = out.windows
                want = times
                for n in classes[u]:
                    take = min(want, left[n])
                    out.give(n, given[n], take, at)
                    given[n] += take
                    left[n] -= take
                    at += take
                    want -= take
            free -= need * times
            out.windows += times
    lengths = np.array(sorted(left), int)
    counts = np.array([left[n] for n in lengths], int)
    while counts.any():
        room, chosen = window, []
        while room and (fits := np.flatnonzero((counts > 0) & (lengths <= room))).size:
            k = int(next((i for i in fits[::-1] if i not in {c for c, _ in chosen}), -1))
            if k < 0:
                break
            n = min(int(counts[k]), room // int(lengths[k]))
            chosen.append((k, n))
            room -= n * int(lengths[k])
        times = min(int(counts[k]) // n for k, n in chosen)
        for k, n in chosen:
            length = int(lengths[k])
            out.give(length, given[length], n * times, out.windows, n)
            given[length] += n * times
            counts[k] -= n * times
        out.windows += times
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The windows and the rest of each document: doc_id, start, length, ids_crc32, doc_tokens."""
    bounded_batches(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            ids, ends = tok.batch(b.column(1))
            for doc, a, e in zip(b.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                n = e - a + 1  # with END
                for s in range(0, n, window):
                    crc = zlib.crc32(ids[a + s : min(a + s + window, e)])
                    rows.append((doc, s, min(window, n - s), zlib.crc32(end, crc) if s + window >= n else crc, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _place(rests: DataFrame, where: dict[int, np.ndarray], window: int, rest_windows: int) -> DataFrame:
    schema = rests.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").schema.add("sequence_id", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = rest_windows + number
            for n in np.unique(length[length < window]):
                own, table = np.flatnonzero(length == n), where[int(n)]
                r = table[np.searchsorted(table[:, 0], number[own], side="right") - 1]
                at[own] = r[:, 2] + (number[own] - r[:, 0]) // r[:, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(at)], schema.names)

    return rests.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece: its document, place there, checksum, window (sequence_id) and offset in the window."""
    found = saved(pieces(docs, tokenizer, window), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    placed = plan(histogram, window)
    rows = _place(gapless(found, ["length"], ["doc_id", "start"], "number"), placed.arrays(), window, placed.windows)
    in_window = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start")  # at most ``window`` pieces
    before = F.sum("length").over(in_window.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
