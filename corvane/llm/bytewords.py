"""Token ids of many texts by a byte-level tokenizer, equal to encoding each text as a whole.

The tokenizer cuts texts into words by WORDS before it merges bytes.  A space between two other characters always begins
a word there, and a line feed between two others is a word, so texts without white space in a row are cut at both,
the distinct parts of an Arrow batch are encoded once, those of letters all in one call, and ids are gathered by numpy.  Other texts are encoded whole.
Added tokens that occur in a text become their own ids, as in the plain call of the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.chat import PROBES, WORDS
from corvane.llm.wordcache import MARKS, byte_letters, gather

#: Any two white-space characters in a row, as the vocabulary's pattern knows white space, or one that is neither space nor line feed.
UNEVEN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
#: Parts that a worker remembers: short ones, up to so many characters in all.
SHORT, REMEMBERED = 48, 16 << 20


class ByteWords:
    """Encodes by the tokenizer file at ``path``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.odd = "|".join([UNEVEN, *map(re.escape, added)])
        self.quick, self.known, self.size = None, {}, 0
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in added and all(c in letters for c in piece)}
        if all(bytes([k]) in ranks for k in range(256)):
            import tiktoken

            self.quick = tiktoken.Encoding("parts", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            if any(self._plain(p) != self.quick.encode_ordinary(p) for p in PROBES if not any(a in p for a in added)):
                self.quick = None
            self.feed = ranks[b"\n"]
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
            self.begins[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            ids = self.quick.encode_ordinary(text) if self.quick else self._plain(text)
            if len(text) <= SHORT:
                if self.size > REMEMBERED:
                    self.known, self.size = {}, 0
                self.known[text] = ids
                self.size += len(text) + 50
        return ids

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text end; a null text has none."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd) if self.quick else pa.array([True] * len(texts))
        even, ends = self._even(pc.if_else(odd, "", texts))
        if not pc.any(odd).as_py():
            return even, ends
        parts = np.split(even, ends[:-1])
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            parts[k] = np.array(self._plain(texts[int(k)].as_py()), "<u4")
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without white space in a row."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        of = lists.flatten().dictionary_encode()
        codes, upto = of.indices.to_numpy().astype(np.int64), np.cumsum(lists.value_lengths().to_numpy())
        feed = codes == pc.index(of.dictionary, "\n").as_py()
        spaced = np.ones(len(codes), bool)  # parts after a space
        spaced[np.append(0, upto[:-1])[: len(upto)]] = False
        spaced[feed] = False
        spaced[1:][feed[:-1]] = False
        keys = 2 * codes + spaced
        there = np.zeros(2 * len(of.dictionary), bool)
        there[keys] = True
        number = np.cumsum(there) - 1
        own = np.flatnonzero(there)
        flat, starts, lengths = self._parts(of.dictionary.take(pa.array(own >> 1)), (own & 1).astype(bool))
        which = number[keys]
        flat, ends = gather(flat, starts[which], lengths[which])
        return flat, np.append(0, ends)[upto]

    def _parts(self, parts: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and lengths of distinct parts: a stem of letters and the marks after it, which the pattern parts."""
        marked = pc.match_substring_regex(parts, rf"^\p{{L}}+[{MARKS}]+$")
        stems = pc.if_else(marked, pc.utf8_rtrim(parts, MARKS), parts)
        marks = pc.if_else(marked, pc.replace_substring_regex(parts, r"^\p{L}+", ""), "").dictionary_encode()
        flat, starts, lengths = [np.empty(0, "<u4")], np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        letters = pc.match_substring_regex(stems, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        done = 0
        for space in (True, False):
            at = np.flatnonzero(letters & (spaced == space))
            if not len(at):
                continue
            of = stems.take(pa.array(at)).dictionary_encode()
            text = (" " if space else "\n") + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(of.dictionary)], pa.int32()), of.dictionary), " " if space else "\n")[0].as_py()
            ids = np.array(self.quick.encode_to_numpy(text, disallowed_special=()), "<u4")
            if space:
                first = np.flatnonzero(self.begins[ids])
                sizes = np.diff(first, append=len(ids))
            else:
                feeds = np.flatnonzero(ids == self.feed)
                sizes = np.diff(feeds, append=len(ids)) - 1
                ids = ids[ids != self.feed]
            which = of.indices.to_numpy()
            starts[at], lengths[at] = done + (np.cumsum(sizes) - sizes)[which], sizes[which]
            flat.append(ids)
            done += len(ids)
        at = np.flatnonzero(~letters)
        odd = [self._part(" " + t if s else t) for t, s in zip(stems.take(pa.array(at)).to_pylist(), spaced[at].tolist(), strict=True)]
        tails = [self._part(t) for t in marks.dictionary.to_pylist()]
        more = np.array([len(i) for i in odd + tails], np.int64)
        flat.append(np.array([x for i in odd + tails for x in i], "<u4"))
        at_more = done + np.cumsum(more) - more
        starts[at], lengths[at] = at_more[: len(odd)], more[: len(odd)]
        tail = len(odd) + marks.indices.to_numpy()
        both = np.stack([starts, at_more[tail]], 1).ravel(), np.stack([lengths, more[tail]], 1).ravel()
        joined, ends = gather(np.concatenate(flat), *both)
        sizes = lengths + more[tail]
        return joined, ends[1::2] - sizes, sizes


_ready: dict[str, ByteWords] = {}


def byte_words(path: str) -> ByteWords:
    """One tokenizer for each worker process."""
    if path not in _ready:
        _ready[path] = ByteWords(path)
    return _ready[path]
