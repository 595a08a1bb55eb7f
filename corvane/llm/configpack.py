"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration says how many rests of each length share one window.  The program asks for the fewest windows, as
fractions of configurations, that hold the histogram; there are far too many configurations to list, so
:func:`fractions` solves it by multiplicative weights.  Each round, the dynamic program of the knapsack (:func:`price`)
gives for each length the filling of greatest weight that holds it; those that are full, or as heavy as the heaviest, are taken as often as the
round's share of each length allows.  Then the weights of lengths that are behind grow and those of lengths ahead fall, around
the weight that equals the length, the dual price where full windows are the best.  Rounded down, the fractions give
windows.  What is left is packed best fit, from the longest on, into the smallest room that holds it, by lengths and counts (:class:`Rooms`).

Only the histogram (at most WINDOW rows, whatever the input) comes to the driver, and the plan says which numbers of the
rests of a length go where, so tasks place pieces without meeting.  A document of more than WINDOW tokens is cut so that its
first piece takes what does not fill a window.

Defined cases: a null or empty text is the one id END; a null doc_id is carried through; repeated rows are packed each for
itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bytewords import byte_words
from corvane.llm.common import bounded_batches, gapless, saved
from corvane.llm.packing import Plan, _place

WINDOW, END = 1024, 2
#: A round places so much more of the lengths than the mean so far, until the mean is ENOUGH or ROUNDS are over.
SHARE, ENOUGH, ROUNDS = 0.06, 0.8, 200
#: The logarithm of a weight moves by at most LEARN a round, and by LIMIT in all; a filling is heavy within NEAR of the heaviest.
LEARN, LIMIT, NEAR = 0.05, 0.3, 0.002
Way = tuple[tuple[int, int], ...]


def price(lengths: np.ndarray, weights: np.ndarray, window: int) -> tuple[np.ndarray, list[int]]:
    """The greatest weight that fits each room, and the place of one length in that filling (-1: the room is one too large).

    Of equal weights the longest length is taken."""
    best, choice = np.zeros(window + 1), [-1] * (window + 1)
    down, worth, last = lengths[::-1].copy(), weights[::-1].copy(), len(lengths) - 1
    first = np.searchsorted(-down, -np.arange(window + 1))
    for room in range(int(lengths[0]), window + 1):
        f = first[room]
        values = best[room - down[f:]] + worth[f:]
        k = int(values.argmax())
        if values[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = values[k], last - f - k
        else:
            best[room] = best[room - 1]
    return best, choice


def filling(k: int, lengths: list[int], choice: list[int], window: int) -> tuple[dict[int, int], int]:
    """The filling of greatest weight that holds the length at place k, and the room that stays."""
    way, room, free = {k: 1}, window - lengths[k], 0
    while room:
        if (j := choice[room]) < 0:
            room, free = room - 1, free + 1
        else:
            way[j] = way.get(j, 0) + 1
            room -= lengths[j]
    return way, free


def fractions(lengths: np.ndarray, counts: np.ndarray, window: int) -> dict[Way, float]:
    """How often to take each configuration, as a fraction; no length is placed more often than it occurs."""
    placed, out = np.zeros(len(lengths)), {}
    base, plain = np.log(lengths.astype(float)), lengths.tolist()
    size, move = lengths * counts, np.zeros(len(lengths))
    for _ in range(ROUNDS):
        share = placed / counts
        mean = np.average(share, weights=size)
        if mean >= ENOUGH:
            break
        move = np.clip(move + LEARN * np.clip((mean - share) / SHARE, -1, 1), -LIMIT, LIMIT)
        move -= np.average(move, weights=size)
        weights = np.exp(base + move)
        best, choice = price(lengths, weights, window)
        value = weights + best[window - lengths]
        heavy = value >= (1 - NEAR) * value.max()
        budget = np.maximum(min(1.0, mean + SHARE) - share, 0) * counts
        for k in reversed(np.flatnonzero(budget > 1e-9 * counts).tolist()):
            way, free = filling(k, plain, choice, window)
            if free and not heavy[k]:
                continue
            step = min(budget[j] / n for j, n in way.items())
            if step > 0:
                key = tuple(sorted(way.items()))
                out[key] = out.get(key, 0.0) + step
                for j, n in way.items():
                    budget[j] -= step * n
                    placed[j] += step * n
    return out


class Rooms:
    """Windows that are not full, as ranges of window numbers by the room that they have."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def put(self, room: int, first: int, many: int) -> None:
        if room and many:
            if room not in self.ranges:
                insort(self.sizes, room)
                self.ranges[room] = []
            self.ranges[room].append((first, many))

    def take(self, length: int, many: int) -> tuple[int, int, int] | None:
        """The smallest room that holds ``length``: the room, the first window, and how many of at most ``many``."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        first, there = self.ranges[room].pop()
        if there > many:
            self.ranges[room].append((first + many, there - many))
        elif not self.ranges[room]:
            del self.ranges[room]
            del self.sizes[at]
        return room, first, min(many, there)


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """Places for histogram[length] rests of each length below ``window``."""
    out, rooms = Plan(), Rooms()
    lengths = np.array(sorted(n for n, c in histogram.items() if c and n < window), np.int64)
    left = [histogram[n] for n in lengths.tolist()]
    given = [0] * len(left)

    def place(k: int, many: int, window_: int, each: int = 1) -> None:
        out.give(int(lengths[k]), given[k], many, window_, each)
        given[k] += many
        left[k] -= many

    solved = fractions(lengths, np.array(left, float), window) if left else {}
    for way, often in sorted(solved.items(), key=lambda w: (-w[1], w[0])):
        if times := min(int(often + 1e-6), *(left[k] // n for k, n in way)):
            for k, n in way:
                place(k, n * times, out.windows, n)
            rooms.put(window - sum(n * int(lengths[k]) for k, n in way), out.windows, times)
            out.windows += times
    for k in reversed(range(len(left))):
        n = int(lengths[k])
        while left[k]:
            if got := rooms.take(n, left[k]):
                room, first, many = got
                place(k, many, first)
                rooms.put(room - n, first, many)
            else:
                each = min(window // n, left[k])
                times = left[k] // each
                place(k, each * times, out.windows, each)
                rooms.put(window - each * n, out.windows, times)
                out.windows += times
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces of each document, the first of which may be shorter: doc_id, start, length, ids_crc32, doc_tokens."""
    bounded_batches(docs.sparkSession)
    end = np.array([END], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = byte_words(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            ids, ends = tok.batch(b.column(1))
            for doc, a, e in zip(b.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                own = np.append(ids[a:e], end)
                n = len(own)
                cuts = [0, *range((n - 1) % window + 1, n + 1, window)]
                rows += [(doc, s, t - s, zlib.crc32(own[s:t].tobytes()), n) for s, t in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece: its document, number and place there, checksum, window (sequence_id) and offset in the window."""
    found = saved(pieces(docs, tokenizer, window), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    placed = plan(histogram, window)
    rows = _place(gapless(found, ["length"], ["doc_id", "start"], "number"), placed.arrays(), window, placed.windows)
    in_window = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start")  # at most ``window`` pieces
    before = F.sum("length").over(in_window.rowsBetween(Window.unboundedPreceding, -1))
    number = F.ceil(F.col("start") / window).cast("int")
    return rows.select("doc_id", number.alias("piece"), "start", "length", "ids_crc32", "sequence_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "doc_tokens")
