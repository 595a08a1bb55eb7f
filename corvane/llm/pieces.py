"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three transducers that are composed with each input:

* the normaliser (:class:`Normaliser`): the longest rule of the model's map that fits, a character without a rule as it is;
  then white space is squeezed if the model says so, and written as marks, one of them before the text;
* the pieces: from every place of the normalised input an arc for each piece that begins there, read from a trie, and
  for a character that is no piece one to the unknown piece or, with byte fallback, to the pieces of its UTF-8 bytes;
* the states: for a unigram model one, with the piece's score as weight (as the negated cost, in 32-bit floats like the
  library); for a BPE model one for each piece, with an arc from piece t to piece u of weight 0 if merging the string tu
  gives back exactly t, u, and of infinite weight otherwise.  A segmentation is that of BPE if all its neighbours are such
  pairs, so the path of least weight is the path that BPE takes.

:meth:`Transducer.shortest_path` is the one search for both: the tropical shortest path forward over the places of the
input.  Of paths of the same weight the one found first stays, as in the library.

No path is searched twice for what stands between two cuts.  A place is a cut if no piece holds the two characters beside
it: between a character and the space mark after it, around a line feed, between a letter and a mark of punctuation.
Batches are cut by Arrow, their distinct parts are looked up among up to PARTS remembered ones of at most STORED bytes, and ids are gathered by
numpy.  Models in which these places are no cuts go text by text instead.  Runs of space marks, whose pieces all tie, are
joined from the left as BPE does.

Defined cases: a null or empty text has no pieces; a null doc_id is carried through; repeated rows are encoded alike; an
empty table gives an empty result; further columns are ignored.  A mark in the text itself is read as a space, as the
library does.  Models with user-defined or unused pieces, or with the space mark as a suffix, are refused.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches
from corvane.llm.wordcache import MARKS, gather

MARK = "\u2581"
#: Parts whose ids a worker remembers, and arcs between pieces; beyond it those that the batch does not use are forgotten.
PARTS, ARCS = 1_000_000, 2_000_000
#: The bytes of remembered parts, which bounds the store where parts are long.
STORED = 128 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file
UNIGRAM, BPE = 1, 2
#: How much worse than the worst piece an unknown character is to a unigram model; fixed value.
UNKNOWN_PENALTY = 10.0


class Normaliser:
    """A model's normaliser, its map compiled to rules by first character."""

    def __init__(self, spec) -> None:
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for key, to in sorted(self._map(spec.precompiled_charsmap), key=lambda r: -len(r[0])):
            self.rules.setdefault(key[0], []).append((key, to))
        self.ruled = re.compile("[" + "".join(map(re.escape, self.rules)) + "]") if self.rules else None

    @staticmethod
    def _map(blob: bytes) -> Iterator[tuple[str, str]]:
        """The rules of a map, walked from the root of its double-array trie: a unit holds the label by which it is
        reached, where its children lie (each at that place xor its label), and whether a key ends there."""
        if not blob:
            return
        size = int.from_bytes(blob[:4], "little")
        units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
        labels = np.arange(1, 256)

        def children_at(at: int) -> int:
            u = int(units[at])
            return at ^ ((u >> 10) << ((u & 512) >> 6))

        todo = [(children_at(0), b"")]
        while todo:
            base, key = todo.pop()
            at = base ^ labels
            own = (at < len(units)) & (units[np.minimum(at, len(units) - 1)] & 0x800000FF == labels)
            for c, k in zip(labels[own].tolist(), at[own].tolist()):
                below, longer = children_at(k), key + bytes([c])
                if units[k] >> 8 & 1:
                    start = int(units[below]) & 0x7FFFFFFF
                    yield longer.decode(), texts[start : texts.index(b"\0", start)].decode()
                todo.append((below, longer))

    def _ruled(self, text: str) -> str:
        out, at = [], 0
        while m := self.ruled.search(text, at):
            out.append(text[at : m.start()])
            for key, to in self.rules[text[m.start()]]:
                if text.startswith(key, m.start()):
                    out.append(to)
                    at = m.start() + len(key)
                    break
            else:
                out.append(text[m.start()])
                at = m.start() + 1
        return "".join(out) + text[at:]

    def of(self, text: str) -> str:
        if self.ruled:
            text = self._ruled(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text


class Transducer:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces, the space mark in front, are compiled")
        self.unigram, self.normaliser = model.trainer_spec.model_type == UNIGRAM, Normaliser(model.normalizer_spec)
        self.prefix = self.normaliser.prefix
        self.id, self.score, self.byte = {}, {}, {}
        self.surface: list[bytes] = []
        self.unknown = 0
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.id[p.piece], self.score[p.piece] = i, p.score
            elif p.type == BYTE and model.trainer_spec.byte_fallback:
                self.byte[int(p.piece[1:-1], 16)] = i
            elif p.type == UNKNOWN:
                self.unknown = i
            shown = {NORMAL: p.piece.replace(MARK, " "), UNKNOWN: model.trainer_spec.unk_surface}.get(p.type, "")
            self.surface.append(bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else shown.encode())
        self.bytes, self.byte_lengths = np.frombuffer(b"".join(self.surface), np.uint8), np.array([len(x) for x in self.surface], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.byte_low, self.byte_high = min(self.byte.values(), default=1), max(self.byte.values(), default=0)
        self.cost = {p: -np.float32(x) for p, x in self.score.items()}
        self.unknown_cost = -(np.float32(min(self.score.values(), default=0.0)) - np.float32(UNKNOWN_PENALTY))
        self.marks = {len(p) for p in self.id if set(p) == {MARK}}
        self.trie: dict = {}
        for p in self.id:
            if self.unigram or len(p) == 1 or set(p) != {MARK}:
                node = self.trie
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = p
        merged = sorted((p for p in self.id if len(p) > 1 and set(p) != {MARK}), key=lambda p: -self.score[p])
        self.rank = {p: k for k, p in enumerate(merged)}  # the order in which BPE merges pieces
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.follows: dict[str | None, dict[str, float]] = {}
        self.arcs = 0
        beside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1) if set(p) != {MARK}}
        #: Whether a space mark after another character is a cut, and whether line feeds and marks after letters are too.
        self.cut_at_marks = not any(x[1] == MARK for x in beside) and MARK in self.id
        self.whole_batches = (
            self.cut_at_marks and not self.unigram and self.prefix and self.normaliser.escape and not self.normaliser.squeeze and not self.normaliser.ruled
            and not any("\n" in x for x in beside) and not any(x[1] in MARKS and x[0].isalpha() for x in beside)
        )
        self.remembered = Remembered(self.parts)

    def split(self, u: str) -> tuple[str, str] | None:
        """The two pieces that BPE merges last to make piece u; None if merging the characters of u makes something else."""
        if u not in self.halves:
            symbols, rank, last = list(u), self.rank, None
            while len(symbols) > 1:
                pairs = [rank.get(x + y, len(rank)) for x, y in zip(symbols, symbols[1:])]
                at = pairs.index(min(pairs))  # the leftmost of equals
                if pairs[at] == len(rank):
                    break
                last = (symbols[at], symbols[at + 1])
                symbols[at : at + 2] = ["".join(last)]
            self.halves[u] = last if len(symbols) == 1 else None
        return self.halves[u]

    def joins(self, t: str | None, u: str) -> bool:
        """Whether a BPE path may go on from piece t (None: the beginning) to piece u.

        Their merges are undone from the last one on.  Wherever two pieces once met across the border, they would have
        merged if their union ranks before the merge that took one of them away.
        """
        if len(u) > 1 and self.split(u) is None:
            return False
        if t is None:
            return True
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            if rank.get(t + u, limit) < limit:
                return False
            a, b = (rank[t] if len(t) > 1 else -1), (rank[u] if len(u) > 1 else -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, t = a, self.split(t)[1]
            else:
                limit, u = b + 1, self.split(u)[0]

    def weight(self, t: str | None, u: str) -> float:
        """The weight of the arc from the state of piece t (None: the beginning) by piece u."""
        if self.unigram:
            return self.cost[u]
        own = self.follows.get(t)
        if own is None:
            own = self.follows[t] = {}
        w = own.get(u)
        if w is None:
            if self.arcs >= ARCS:
                self.follows, self.arcs = {t: (own := {})}, 0
            self.arcs += 1
            w = own[u] = 0.0 if self.joins(t, u) else float("inf")
        return w

    def shortest_path(self, s: str) -> list[str]:
        """The pieces of the least path over ``s``; a character without a piece is given as itself.

        A unigram model has one state.  For BPE the pieces up to a place are those of BPE up to there, so that at most one
        state of each place is reached by finite weight; so each place holds one state.
        """
        n, trie, infinite, weight = len(s), self.trie, float("inf"), self.weight
        cost, state, before = [infinite] * (n + 1), [None] * (n + 1), [0] * (n + 1)
        cost[0] = np.float32(0) if self.unigram else 0.0
        for at in range(n):
            here, t = cost[at], state[at]
            if here == infinite:
                continue
            node, end = trie.get(s[at]), at + 1
            single = node is not None and "" in node
            while node is not None:
                u = node.get("")
                if u is not None:
                    w = here + weight(t, u)
                    if w < cost[end]:
                        cost[end], state[end], before[end] = w, u, at
                if end == n:
                    break
                node = node.get(s[end])
                end += 1
            if not single:  # the arc of a character that is no piece
                w = here + self.unknown_cost if self.unigram else here
                if w < cost[at + 1]:
                    cost[at + 1], state[at + 1], before[at + 1] = w, s[at], at
        out, at = [], n
        while at:
            out.append(state[at])
            at = before[at]
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            else:
                out += [self.byte.get(b, self.unknown) for b in p.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]
        return out

    def run(self, k: int) -> list[int]:
        """The ids of k space marks in a row: the leftmost neighbours that form a piece merge until none do."""
        sizes: list[int] = []
        for _ in range(k):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.marks:
                last = sizes.pop()
                sizes[-1] += last
        return [self.id[MARK * n] for n in sizes]

    def parts(self, keys: list[str]) -> list[list[int]]:
        """The ids of parts: what stands after a space mark, or after a line feed if it begins with one."""
        return [self.ids_of((["\n"] + (self.shortest_path(k[1:]) if k[1:] else [])) if k[:1] == "\n" else self.shortest_path(MARK + k)) for k in keys]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text end; a null text has none."""
        texts = texts.fill_null("")
        if not self.whole_batches:
            each = [self.encode(x) for x in texts.to_pylist()]
            return np.concatenate([*each, np.empty(0, "<u4")]), np.cumsum([len(e) for e in each], dtype=np.int64)
        words = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, MARK, " "), "\n", " \n"), " ")
        of = words.values.dictionary_encode()
        marked = pc.match_substring_regex(of.dictionary, rf"^\p{{L}}+[{MARKS}]+$")
        stems = pc.if_else(marked, pc.utf8_rtrim(of.dictionary, MARKS), of.dictionary).dictionary_encode()
        tails = pc.if_else(marked, pc.replace_substring_regex(of.dictionary, r"^\p{L}+", ""), "").dictionary_encode()
        flat, starts, lengths = self.remembered.get(stems.dictionary)
        after = [self.ids_of(self.shortest_path(t)) for t in tails.dictionary.to_pylist()]
        many = np.array([len(x) for x in after], np.int64)
        starts = np.concatenate([starts, len(flat) + np.cumsum(many) - many])
        flat, lengths = np.concatenate([flat, np.array([i for x in after for i in x], "<u4")]), np.concatenate([lengths, many])
        at = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)], axis=1).ravel()
        flat, ends = gather(flat, starts[at], lengths[at])  # the distinct words
        ends = ends[1::2]
        lengths, which = np.diff(ends, prepend=0), of.indices.to_numpy()
        ids, ends = gather(flat, (ends - lengths)[which], lengths[which])
        ends = np.append(0, ends)[words.offsets.to_numpy()[1:]]
        return self._tidied(ids, ends, pc.binary_length(texts).to_numpy() == 0)

    def _tidied(self, ids: np.ndarray, ends: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the mark of empty texts, and with runs of lone marks joined."""
        alone, first = ids == self.id[MARK], np.zeros(len(ids), bool)
        first[(ends[:-1])[ends[:-1] < len(ids)]] = True
        run = np.flatnonzero(alone[1:] & alone[:-1] & ~first[1:])
        texts = np.unique(np.searchsorted(ends, run, side="right"))
        if not len(texts) and not empty.any():
            return ids, ends
        each = np.split(ids, ends[:-1])
        for k in texts.tolist():
            each[k] = self._join_runs(each[k], each[k] == self.id[MARK])
        for k in np.flatnonzero(empty).tolist():
            each[k] = ids[:0]
        return np.concatenate([*each, ids[:0]]), np.cumsum([len(e) for e in each], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        if not text:
            return np.empty(0, "<u4")
        if self.whole_batches:
            return self.batch(pa.array([text]))[0]
        s = self.normaliser.of(text)
        cut = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", s) if self.cut_at_marks and (self.unigram or MARK * 2 not in s) else [s]
        ids = np.array([i for part in cut for i in self.ids_of(self.shortest_path(part))], "<u4")
        if not self.unigram and self.marks - {1}:
            ids = self._join_runs(ids, ids == self.id.get(MARK, -1))
        if not self.byte:  # neighbouring unknown characters are one unknown piece
            ids = ids[np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))[: len(ids)]]
        return ids

    def _join_runs(self, ids: np.ndarray, alone: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], alone.astype(np.int8), [0]])))
        out, at = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a > 1:
                out += [ids[at:a], np.array(self.run(b - a), "<u4")]
                at = b
        return np.concatenate([*out, ids[at:]])

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transducer: pieces to text, bytes put together, the mark before the text left out."""
        text = gather(self.bytes, self.byte_starts[ids], self.byte_lengths[ids])[0].tobytes()
        return (text[1:] if self.prefix and text[:1] == b" " else text).decode("utf-8", "replace")


class Remembered:
    """The ids of parts that a worker met before, in a few flat arrays."""

    def __init__(self, make) -> None:
        self.make = make
        self.keys, self.starts, self.lengths, self.flat = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def get(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and lengths of distinct ``keys``; those not met before are made and remembered."""
        at = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(self.keys) + len(new) > PARTS or self.keys.nbytes + new.nbytes > STORED:
            used = at[at >= 0]
            self.flat, ends = gather(self.flat, self.starts[used], self.lengths[used])
            self.keys, self.lengths = self.keys.take(pa.array(used)), self.lengths[used]
            self.starts = ends - self.lengths
            at[at >= 0] = np.arange(len(used))
        if len(new):
            at[at < 0] = len(self.keys) + np.arange(len(new))
            made = self.make(new.to_pylist())
            many = np.array([len(x) for x in made], np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(many) - many])
            self.flat = np.concatenate([self.flat, np.array([i for x in made for i in x], "<u4")])
            self.lengths, self.keys = np.concatenate([self.lengths, many]), pa.concat_arrays([self.keys, new])
        return self.flat, self.starts[at], self.lengths[at]


_ready: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each worker process."""
    if path not in _ready:
        _ready[path] = Transducer(path)
    return _ready[path]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids, the piece ids of each text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            ids, ends = t.batch(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def report(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of pieces and of byte pieces, a checksum of the ids (unsigned 32-bit, little-endian), and
    the digest and length of the text decoded from the ids."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_chars", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            rows = []
            all_ids, ends = t.batch(b.column(1))
            for ids in np.split(all_ids, ends[:-1]) if len(ends) else []:
                back = t.decode(ids)
                rows.append((len(ids), int(((ids >= t.byte_low) & (ids <= t.byte_high)).sum()), zlib.crc32(ids.tobytes()), len(back), hashlib.sha256(back.encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_chars long, decoded_sha256 string")
