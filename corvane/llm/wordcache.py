"""Token ids of many texts by a tokenizer that treats words apart.

A whole Arrow batch is lower-cased, split and dictionary-encoded at once; only its distinct words are encoded, and the ids
of all words are gathered by numpy.  No step is taken word by word in Python, and nothing is kept from batch to batch.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands between words that are encoded in one call; one id, which no text without this character gives.
BETWEEN, TOGETHER = "\x01", 256
#: Marks that are split off the end of a word of letters, so that a word is encoded once for all marks after it.
MARKS = ".,;:!?"
#: Letters that end in no combining mark once they are normalised, so that punctuation after them is a word of its own.
ALONE = r"[a-zA-Z\x{c0}-\x{12f}\x{131}-\x{24f}\p{Greek}\p{Cyrillic}\p{Han}]"
#: Words that no normaliser changes, and what ends them in the byte-pair ranks.
PLAIN, ENDING = "^[a-zß-öø-ÿ]+$", "\x00"
#: Texts that tell whether a tokenizer treats words apart, and A-Z like a-z.
PROBES = ("a b", "One, two!\nthree?", "don't 'll we've", "1.5 x2 a-b", "éx ́", "İs ΣΑΣ. ſ", "<|endoftext|> #!?", "a.b. ...c ;d", "internationalisation größe übermäßig déjà señor ça")


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after the other, and where each ends."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at], ends


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(prints)))}


def _same(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    return all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


class WordIds:
    """Texts to token ids, equal to encoding each text as a whole.

    For tokenizers that drop white space and never join across it; any other one is found out by PROBES when it is loaded,
    and is given whole texts.  Texts are split at spaces and line feeds only; other white space stays inside a "word" and
    is left to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ordinary = Tokenizer.from_file(path)
        self.ordinary.encode_special_tokens = True  # texts with such strings go to the plain one, whole
        between = self._ids([BETWEEN])[0]
        self.between = int(between[0]) if len(between) == 1 else None
        self.ranks, self.ends_word = self._byte_pairs(path)
        probes, whole = pa.array(PROBES), self._ids(list(PROBES))
        self.lower = _same(whole, self._ids(pc.ascii_lower(probes).to_pylist()))
        self.apart = self.between is not None and self._fits(probes, whole)
        if not self.apart and self.ranks is not None:
            self.ranks = None
            self.apart = self.between is not None and self._fits(probes, whole)

    def _fits(self, probes: pa.Array, whole: list[np.ndarray]) -> bool:
        ids, ends = self._split(probes)
        return len(ends) == len(whole) and _same(whole, np.split(ids, ends[:-1]))

    @staticmethod
    def _byte_pairs(path: str) -> tuple[object | None, np.ndarray | None]:
        """For a byte-level vocabulary with word ends, whose ids are the order of merging: the same ranks for the quicker
        library, each word followed by ENDING, and which ids end a word."""
        with open(path) as f:
            model = json.load(f)["model"]
        letters, suffix = byte_letters(), model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix:
            return None, None
        import tiktoken

        ranks, ends = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
        for piece, i in model["vocab"].items():
            body = piece.removesuffix(suffix)
            if all(c in letters for c in body):
                ends[i] = body != piece
                ranks[bytes(letters[c] for c in body) + ENDING.encode() * bool(ends[i])] = i
        if any(bytes([b]) not in ranks for b in range(256)):
            return None, None
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ends

    def of(self, texts: list[str], piece_chars: int = 2 << 20) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            j, size = k, 0
            while j < len(texts) and (j == k or size + len(texts[j]) <= piece_chars):
                size += len(texts[j])
                j += 1
            ids, ends = self.batch(pa.array(texts[k:j], pa.string()))
            out += [x.tobytes() for x in np.split(ids, ends[:-1])]
            k = j
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text end; a null text has none."""
        texts = texts.fill_null("")
        if self.apart and not self.added:
            return self._split(texts)
        special = pc.match_substring_regex(texts, "|".join(self.added), ignore_case=True).to_numpy(zero_copy_only=False) if self.apart else np.ones(len(texts), bool)
        if not special.any():
            return self._split(texts)
        ids, ends = self._split(pc.if_else(pa.array(special), "", texts)) if self.apart else (np.empty(0, "<u4"), np.zeros(len(texts), np.int64))
        each = np.split(ids, ends[:-1])
        for k in np.flatnonzero(special).tolist():
            each[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate([*each, np.empty(0, "<u4")]), np.cumsum([len(e) for e in each], dtype=np.int64)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        low = pc.ascii_lower(texts) if self.lower else texts
        words = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        of = words.values.dictionary_encode()
        ids, ends = gather(*self._distinct(of.dictionary, of.indices.to_numpy()))
        return ids, np.append(0, ends)[words.offsets.to_numpy()[1:]]

    def _distinct(self, words: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and lengths of the words numbered ``which``, encoded as a stem and the marks after it."""
        marked = pc.and_(pc.match_substring_regex(words, rf"^\p{{L}}+[{MARKS}]+$"), pc.match_substring_regex(words, rf"{ALONE}[{MARKS}]+$"))
        stems = pc.if_else(marked, pc.utf8_rtrim(words, MARKS), words)
        marks = pc.if_else(marked, pc.replace_substring_regex(words, r"^\p{L}+", ""), "")
        units = pa.concat_arrays([stems, marks]).dictionary_encode()
        flat, starts, lengths = self._encoded(units.dictionary)
        at = units.indices.to_numpy().reshape(2, -1).T.ravel()
        flat, ends = gather(flat, starts[at], lengths[at])
        ends = ends[1::2]
        lengths = np.diff(ends, prepend=0)
        return flat, (ends - lengths)[which], lengths[which]

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and lengths of distinct units; most are encoded many at a time."""
        plain = pc.match_substring_regex(units, PLAIN) if self.ranks is not None else pa.array(np.zeros(len(units), bool))
        is_plain, lengths, starts = plain.to_numpy(zero_copy_only=False), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        flat: list[np.ndarray] = []
        if is_plain.any():
            own = units.filter(plain)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), ENDING)[0].as_py() + ENDING
            flat.append(np.array(self.ranks.encode_to_numpy(text, disallowed_special=()), "<u4"))
            lengths[is_plain] = np.diff(np.flatnonzero(self.ends_word[flat[0]]), prepend=-1)
        odd, counts = units.filter(pc.invert(plain)).to_pylist(), []
        for k in range(0, len(odd), 100 * TOGETHER):
            groups = [odd[i : i + TOGETHER] for i in range(k, min(k + 100 * TOGETHER, len(odd)), TOGETHER)]
            for group, e in zip(groups, self._ids([f" {BETWEEN} ".join(g) for g in groups]), strict=True):
                cut = np.flatnonzero(e == self.between)
                if len(cut) == len(group) - 1:
                    flat.append(e[e != self.between])
                    counts.append(np.diff(cut, prepend=-1, append=len(e)) - 1)
                else:  # a word holds the character itself
                    each = self._ids(group)
                    flat += each
                    counts.append(np.array([len(x) for x in each], np.int64))
        lengths[~is_plain] = np.concatenate([*counts, np.empty(0, np.int64)])
        for own, base in ((is_plain, 0), (~is_plain, int(lengths[is_plain].sum()))):
            starts[own] = base + np.cumsum(lengths[own]) - lengths[own]
        return np.concatenate([*flat, np.empty(0, "<u4")]), starts, lengths

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.ordinary.encode_batch_fast(texts, add_special_tokens=False)]


_ready: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer for each worker process."""
    if path not in _ready:
        _ready[path] = WordIds(path)
    return _ready[path]
