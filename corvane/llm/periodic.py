"""Periodic runs of words by Baier grouping.

A run is a stretch of consecutive words with smallest period q, of at least max(LEAST, TIMES * q) words, that no
neighbouring word extends.  The first phase of Baier's suffix sorter puts the positions of a text into groups by their
longest Lyndon prefix, going through groups from the highest to the lowest; its groups and their lengths are the Lyndon
array (:func:`groups`).  Every run holds, under the order of words or under the reverse order, copies of a Lyndon root
one after the other, all in one group; :func:`runs` finds such chains under both orders and extends each to both sides
by the longest common extension (:func:`extension`).

Before that, :func:`repeating` leaves out words that no run can hold: every four words in a row within a run occur there
twice or more, so a stretch without such repeats is cut away, again and again within what is left.  This loses no run,
as equal hashes can only keep more.

All work is by row, on whole texts: nothing is shuffled.  Words of an Arrow batch, bounded in bytes, are numbered once;
only stretches that repeat reach the grouping, which takes linear time and memory.

Defined cases: a null or empty text has no words and no runs; a null doc_id is never damaged; repeated rows are taken each
for itself; an empty table gives an empty result; further columns are ignored.  Of runs with equal exponent the one that starts first, then
the one of the smaller period, is the greatest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches
from corvane.llm.wordcache import gather

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words in a row that occur twice in a run of that size, and how many such places follow each other in the shortest run.
GRAM, PLACES = 4, 3
_ODD = (np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)).tolist()


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the number of each word in a row, and where the words of each text end."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts.fill_null(""), "[\t\n\x0b\x0c\r]", " "), " ")
    of = lists.flatten().dictionary_encode()
    codes = of.indices.to_numpy()
    keep = codes != pc.index(of.dictionary, "").as_py()  # -1 where no text is empty or has white space in a row
    sizes = lists.value_lengths().to_numpy()
    return of.dictionary, codes[keep].astype(np.int64), np.append(0, np.cumsum(keep))[np.cumsum(sizes)]


def damaged(codes: np.ndarray, ends: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """A copy in which each tenth document, by the checksum of its id, repeats a stretch up to its end."""
    out = codes.copy()
    for doc, a, b in zip(ids, [0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        if doc is None or a == b or (h := zlib.crc32(str(doc).encode())) % 10:
            continue
        n, g = b - a, h // 10
        at = g % n
        p = 1 + (n - at) // (3 + g % 8)
        out[a + at : b] = codes[a + at + np.arange(n - at) % p]
    return out


def repeating(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches in which runs can be: every four words in a row occur again within them."""
    starts, stops = np.append(0, ends[:-1])[: len(ends)], ends
    for salt in range(64):
        big = stops - starts >= LEAST
        starts, stops = starts[big], stops[big]
        size = int((stops - starts).sum())
        if not size:
            break
        own, upto = gather(codes, starts, stops - starts)
        which = np.repeat(np.arange(len(starts)), stops - starts)
        key = which.astype(np.uint64) * np.uint64(_ODD[4]) + np.uint64(salt)
        n = size - GRAM + 1
        key = key[:n]
        for k in range(GRAM):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(_ODD[k]) + own[k : n + k].astype(np.uint64)
        key = (key * np.uint64(_ODD[0])) >> np.uint64(64 - max(8, (2 * size).bit_length()))
        inside = which[:n] == which[GRAM - 1 :]
        counts = np.bincount(key[inside].astype(np.int64))
        live = np.zeros(n + 2, bool)
        live[1:-1][inside] = counts[key[inside].astype(np.int64)] >= 2
        edge = np.flatnonzero(live[1:] != live[:-1])
        a, b = edge[::2], edge[1::2]
        a, b = a[b - a >= PLACES], b[b - a >= PLACES]
        shift = starts - (upto - (stops - starts))
        new_starts, new_stops = a + shift[which[a]], b + GRAM - 1 + shift[which[a]]
        done = int((new_stops - new_starts).sum()) == size
        starts, stops = new_starts, new_stops
        if done:
            break
    return starts, stops


def groups(word: np.ndarray) -> tuple[list[int], list[int]]:
    """The group of each position, by its longest Lyndon prefix, and the length of that prefix for each group."""
    letters, first = np.unique(word, return_inverse=True)
    n, m = len(word), len(letters)
    group, order = first.tolist(), np.argsort(first, kind="stable")
    members = [x.tolist() for x in np.split(order, np.cumsum(np.bincount(first))[:-1])]
    size, length = [len(x) for x in members], [1] * m
    below, above = list(range(-1, m - 1)), [*range(1, m), -1]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # the positions still to come, linked
    before.append(0)

    def split(old: int, moved: list[int], longer: int) -> None:
        """``moved`` leave their group for one just above it, whose prefixes are longer."""
        if len(moved) == size[old]:
            length[old] += longer
            return
        new, up = len(length), above[old]
        length.append(length[old] + longer)
        size.append(len(moved))
        members.append(moved)
        size[old] -= len(moved)
        below.append(old)
        above.append(up)
        above[old] = new
        below[up] = new  # the group now at work lies above, so there is one
        for j in moved:
            group[j] = new

    g = m - 1
    while g >= 0:
        own, longer = members[g], length[g]
        members[g] = []
        if size[g] == 1:
            i = own[0] if len(own) == 1 else next(i for i in own if group[i] == g)
            j, k = before[i], after[i]
            before[k] = j
            if j >= 0:
                after[j] = k
                split(group[j], [j], longer)
        else:
            targets: list[int] = []
            times: list[int] = []
            for i in own:
                if group[i] != g:
                    continue
                j, k = before[i], after[i]
                before[k] = j
                if j < 0:
                    continue
                after[j] = k
                if targets and targets[-1] == j:
                    times[-1] += 1
                else:
                    targets.append(j)
                    times.append(1)
            for many in sorted(set(times), reverse=True):
                parts: dict[int, list[int]] = {}
                for j, t in zip(targets, times, strict=True):
                    if t == many:
                        parts.setdefault(group[j], []).append(j)
                for old, moved in parts.items():
                    split(old, moved, many * longer)
        g = below[g]
    return group, length


def extension(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words of a and b agree."""
    differ = a != b
    k = int(differ.argmax()) if len(differ) else 0
    return k if len(differ) and differ[k] else len(differ)


def runs(word: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run, in order."""
    n, found = len(word), {}
    for order in (word, -word):
        group, length = groups(order)
        g = np.array(group)
        step = np.array(length)[g]
        to = np.arange(n) + step
        again = np.zeros(n, bool)
        inside = np.flatnonzero(to < n)
        again[inside] = g[inside] == g[to[inside]]
        back = np.arange(n) - step
        goes_on = (back >= 0) & (g[np.maximum(back, 0)] == g)
        chain = again & ~goes_on
        at = np.flatnonzero(chain)
        for i in at[again[to[at]]].tolist():
            p, stop = int(step[i]), i
            while again[stop]:
                stop += p
            stop += p
            left = extension(word[max(0, i - p) : i][::-1], word[max(0, i - p) + p : i + p][::-1])
            stop += extension(word[stop : stop + p], word[stop - p : min(stop, n - p)])
            if stop - i + left >= max(LEAST, TIMES * p):
                found[i - left, p] = stop - i + left
    return [(s, found[s, p], p) for s, p in sorted(found)]


def found(codes: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each text; ``codes`` are the words of all texts in a row."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    starts, stops = repeating(codes, ends)
    begins = np.append(0, ends)
    for a, b, d in zip(starts.tolist(), stops.tolist(), np.searchsorted(ends, starts, side="right").tolist(), strict=True):
        shift = a - int(begins[d])
        out[d] += [(s + shift, n, p) for s, n, p in runs(codes[a:b])]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(codes: np.ndarray, ends: np.ndarray, all_runs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Which words stay when each run keeps its first period only."""
    step, base = np.zeros(len(codes) + 1, np.int64), np.append(0, ends)
    for d, own in enumerate(all_runs):
        for s, n, p in own:
            step[base[d] + s + p] += 1
            step[base[d] + s + n] -= 1
    return np.cumsum(step)[:-1] == 0


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame, damage: bool = True) -> DataFrame:
    """One row for each document: its runs, the greatest of them, and digests of all runs and of the text without repeats."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words, codes, ends = numbered(b.column(1))
            if damage:
                codes = damaged(codes, ends, ids)
            all_runs = found(codes, ends)
            keep = collapsed(codes, ends, all_runs)
            offsets = np.append(0, np.append(0, np.cumsum(keep))[ends]).astype(np.int32)
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(codes[keep]))), " ").cast(pa.binary())
            rows = []
            for doc, own, text in zip(ids, all_runs, left, strict=True):
                listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest()
                best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else None
                rows.append((doc, len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, listed, hashlib.sha256(text.as_buffer()).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
