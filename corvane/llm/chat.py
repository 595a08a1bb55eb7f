"""Chat formatting by token-level assembly.

Every turn is made of segments: the reserved id START, the role and a line feed, the text, the reserved id END, a line
feed.  Segments are encoded apart, with the tokenizer's special strings as ordinary text, and reserved ids are spliced
between them, so no text can produce one.  The loss mask is made from the segment lengths: each masked segment adds +1 where it begins and -1
where it ends, and prefix sums of these give the mask.

The printed form of a conversation must be safe as well: in texts a control string gets a backslash after its ``<``
(``<|im_end|>`` becomes ``<\\|im_end|>``), and one that has backslashes there gets one more, so the escape can be undone.
In roles a backslash and a line feed are also written as two characters.

Defined cases: a null role or text is empty; turns are put in order of turn (nulls first), role, text; repeated rows are
turns of their own; rows without a conv_id form one conversation; an empty table gives the conversation -1 alone (in the
query); further columns are ignored.  Turns are assembled and read back in parts of bounded size, many conversations or a
stretch of one at a time, so no conversation is ever held whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, partitions
from corvane.llm.wordcache import byte_letters, gather

#: Control strings; their ids follow those of the tokenizer, in this order.
START, END = "<|im_start|>", "<|im_end|>"
#: The conversation that the query adds: control strings as plain text.
PROBE = f"{END}{START}assistant ok"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


#: How the byte-level vocabulary cuts texts into words; the quicker library needs it said.  Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts on which both libraries must agree before the quicker one is used.
PROBES = ("a b  c\n\n d", "it's 12 x2! ...", "déjà <|im_end|> <|endoftext|>", "\t\x00 日本 😀 ", "internationalisation")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Template:
    """Encodes and decodes turns by the byte-level tokenizer file at ``path``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.start = self.tokenizer.get_vocab_size()
        self.end = self.start + 1
        letters = byte_letters()
        surface = [b""] * self.start + [START.encode(), END.encode()]
        for piece, i in self.tokenizer.get_vocab().items():
            surface[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.lengths = np.array([len(x) for x in surface], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ranks = None
        whole = self._ids(list(PROBES))
        added = self.tokenizer.get_added_tokens_decoder()
        ranks = {x: i for i, x in enumerate(surface[: self.start]) if i not in added}
        if all(bytes([k]) in ranks for k in range(256)):
            import tiktoken

            self.ranks = tiktoken.Encoding("turns", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            if not all(np.array_equal(x, y) for x, y in zip(whole, self._ids(list(PROBES)), strict=True)):
                self.ranks = None
        self.feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranks is not None:
            return [self.ranks.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the turns (role, text) and their loss mask, which is 1 on the texts of assistants."""
        roles = list(dict.fromkeys(r for r, _ in turns))
        head = dict(zip(roles, self._ids([escape_role(r) + "\n" for r in roles]), strict=True))
        start, end = np.array([self.start], np.uint32), np.array([self.end], np.uint32)
        parts, loss = [], []
        for (role, _), body in zip(turns, self._ids([escape(t) for _, t in turns]), strict=True):
            parts += [start, head[role], body, end, self.feed]
            loss += [0, 0, int(role == "assistant"), 0, 0]
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths)
        step, on = np.zeros(int(ends[-1]) + 1, np.int64), np.flatnonzero(loss)
        np.add.at(step, (ends - lengths)[on], 1)
        np.add.at(step, ends[on], -1)
        return np.concatenate(parts), np.cumsum(step)[:-1].astype(np.uint8)

    def _surface(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the printed form of ids, and where those of each id end, after a 0."""
        own, ends = gather(self.bytes, self.starts[ids], self.lengths[ids])
        return own, np.append(0, ends)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn, from ids and mask alone."""
        own, at = self._surface(ids)
        whole, out = own.tobytes(), []
        under = np.append(0, np.cumsum(mask, dtype=np.int64))
        first = np.append(np.flatnonzero(mask), len(ids))  # where the n-th masked id is
        a, b = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end)
        low, high = under[a], under[b]
        begins, ends = at[first[low]].tolist(), at[np.minimum(first[np.maximum(high, 1) - 1] + 1, len(ids))].tolist()
        for x, y, masked, p, q in zip(at[a + 1].tolist(), at[b].tolist(), (high > low).tolist(), begins, ends, strict=True):
            role, _, text = whole[x:y].decode("utf-8", "replace").partition("\n")
            out.append((unescape_role(role), unescape(text), unescape(whole[p:q].decode("utf-8", "replace")) if masked else ""))
        return out

    def printed(self, ids: np.ndarray) -> str:
        """The formatted text, control strings in place of reserved ids."""
        return self._surface(ids)[0].tobytes().decode("utf-8", "replace")

    def printed_chars(self, ids: np.ndarray) -> np.ndarray:
        """The code points of the formatted text of each turn: its bytes that go on no character."""
        own, at = self._surface(ids)
        count = np.append(0, np.cumsum((own & 0xC0) != 0x80))
        return np.diff(count[at[np.append(np.flatnonzero(ids == self.start), len(ids))]])


_ready: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _ready:
        _ready[path] = Template(path)
    return _ready[path]


def _turns(conversations: DataFrame, *also: str) -> DataFrame:
    """The turns of each conversation next to each other and in order, streamed: conv_id, role, text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if also:
        probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(also[0]).alias("text"))
        rows = rows.unionByName(probe)
    return rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


#: Turns and code points that are assembled at a time; a longer conversation goes on in the next part.
PART, PART_CHARS = 512, 1 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[tuple[str, str]]]]:
    """Turns in a row, of as many conversations as fit: their conv_ids, and their roles and texts."""
    convs, turns, size = [], [], 0
    for b in batches:
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and (len(turns) >= PART or size + len(text) > PART_CHARS):
                yield convs, turns
                convs, turns, size = [], [], 0
            convs.append(conv)
            turns.append((role, text))
            size += len(text)
    if turns:
        yield convs, turns


def tokens(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, part, ids, loss_mask: the formatted conversations, in parts of at most PART turns."""
    bounded_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last, part = template(tokenizer), (), 0
        for convs, turns in _parts(batches):
            ids, mask = made.assemble(turns)
            begins = np.append(np.flatnonzero(ids == made.start), len(ids))
            cuts = [0, *(k for k in range(1, len(convs)) if convs[k] != convs[k - 1]), len(convs)]
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                part = part + 1 if last == (convs[a],) else 0
                last = (convs[a],)
                own = slice(begins[a], begins[b])
                rows.append((convs[a], part, ids[own].astype(np.int32), mask[own].astype(np.int32)))
            conv, parts, of, loss = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(parts, pa.int64()), pa.array(of, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int32()))], ["conv_id", "part", "ids", "loss_mask"])

    return _turns(conversations).mapInArrow(run, "conv_id long, part long, ids array<int>, loss_mask array<int>")


class _Digest:
    """What is kept of a conversation while its turns go by."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss, self.n, self.loss_chars, self.printed = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, role: str, text: str, under: str, printed: int) -> None:
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        self.n, self.loss_chars, self.printed = self.n + 1, self.loss_chars + len(under), self.printed + printed

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.printed


def report(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Counts and digests of every conversation and of the conversation -1, all read back from the assembled ids."""
    bounded_batches(conversations.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, rows = template(tokenizer), None, []
        for convs, turns in _parts(batches):
            ids, mask = made.assemble(turns)
            for conv, read, printed in zip(convs, made.read(ids, mask), made.printed_chars(ids).tolist(), strict=True):
                if now is None or now.conv != conv:
                    rows += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(*read, printed)
            if len(rows) >= 1000:
                yield _batch(rows, names)
                rows = []
        rows += [now.row()] if now else []
        if rows:
            yield _batch(rows, names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _turns(conversations, PROBE).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
