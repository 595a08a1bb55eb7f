"""The transducer on models of other kinds, written by hand, against the library."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corvane.llm")

import sentencepiece  # noqa: E402
from sentencepiece import sentencepiece_model_pb2  # noqa: E402

from corvane.llm import pieces  # noqa: E402

TEXTS = ["", " ", "a", "  a  b ", "abcab bca", "xyz ab", "abéè 日本 c", "▁a b", "ﬁne ①② Ａｂｃ", "a\tb\nc", "ab  　 cab", "éa ñ", "한국 abc"]


def write(tmp_path, unigram, fallback, rule, squeeze=False, prefix=True):
    r = np.random.default_rng(3)
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type = 1 if unigram else 2
    m.trainer_spec.byte_fallback = fallback
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    m.normalizer_spec.precompiled_charsmap = sentencepiece_model_pb2.ModelProto.FromString(spec.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = prefix, squeeze, True
    kinds = [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256) if fallback]
    for piece, kind in kinds:
        m.pieces.add(piece=piece, score=0.0, type=kind)
    seen = dict.fromkeys(["▁", *"abcfinext12"])
    while len(seen) < 90:
        seen["".join(r.choice(list("▁abc"), 1)) + "".join(r.choice(list("abcn"), int(r.integers(1, 4))))] = None
    for k, piece in enumerate(seen):
        m.pieces.add(piece=piece, score=float(np.float32(-r.integers(1, 40) / 4)) if unigram else float(-k), type=1)
    path = tmp_path / "own.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("rule, squeeze, prefix", [("identity", False, True), ("nmt_nfkc", True, True), ("nfkc_cf", True, False), ("nmt_nfkc", False, True)])
def test_unigram_models_equal_the_library(tmp_path, fallback, rule, squeeze, prefix):
    path = write(tmp_path, True, fallback, rule, squeeze, prefix)
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path)
    r = np.random.default_rng(4)
    texts = TEXTS + ["".join(r.choice(list("aaabbbcc nqz é①"), int(r.integers(1, 30)))) for _ in range(400)]
    ids, ends = t.batch(pa.array(texts))
    for x, got in zip(texts, np.split(ids, ends[:-1])):
        assert got.tolist() == sp.encode(x), (x, sp.encode(x, out_type=str))


def test_normaliser_equals_the_library(tmp_path):
    path = write(tmp_path, True, True, "nmt_nfkc", True)
    sp, n = sentencepiece.SentencePieceNormalizer(model_file=path), pieces.Transducer(path).normaliser
    r = np.random.default_rng(5)
    texts = TEXTS + ["".join(chr(int(c)) for c in r.integers(32, 0x3400, 40)) for _ in range(100)]
    assert [n.of(x) for x in texts] == [sp.normalize(x) for x in texts]


def test_models_that_are_not_compiled_are_refused(tmp_path):
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type = 1
    m.pieces.add(piece="<unk>", score=0.0, type=2)
    m.pieces.add(piece="xx", score=0.0, type=4)
    path = tmp_path / "user.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Transducer(str(path))


def test_a_full_store_forgets_and_stays_right(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(pieces, "PARTS", 200)
    monkeypatch.setattr(pieces, "ARCS", 100)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, t, r = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path), np.random.default_rng(6)
    for _ in range(12):
        texts = [" ".join("".join(r.choice(list("abcdest.,"), int(r.integers(1, 8)))) for _ in range(20)) for _ in range(8)] + ["", "  x   y", None]
        ids, ends = t.batch(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [sp.encode(x or "") for x in texts]


def test_a_run_of_very_many_spaces(tmp_path):
    """Equal to merging the leftmost neighbours on a list, and linear in the length of the run."""
    t = pieces.Transducer.__new__(pieces.Transducer)
    r = np.random.default_rng(8)

    def slow(k):
        sizes, at = [1] * k, 0
        while at < len(sizes) - 1:
            if sizes[at] + sizes[at + 1] in t.marks:
                sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        return sizes

    for _ in range(30):
        t.marks = {1, *map(int, r.integers(2, 20, 6))}
        t.id = {pieces.MARK * n: n for n in t.marks}
        for k in (1, 2, 3, 17, 64, 257):
            assert t.run(k) == slow(k)
    assert sum(t.run(2_000_000)) == 2_000_000


def test_the_store_of_parts_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "STORED", 1000)
    store = pieces.Remembered(lambda keys: [[len(k)] for k in keys])
    for i in range(50):
        keys = pa.array([f"{i}{'x' * 90}", f"{i}y", "kept"])
        flat, starts, lengths = store.get(keys)
        assert flat[starts].tolist() == [len(k) for k in keys.to_pylist()] and lengths.tolist() == [1, 1, 1]
        assert store.keys.nbytes <= 2500
