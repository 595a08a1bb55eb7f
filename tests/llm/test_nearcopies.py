"""The near-dedup stage against all pairs of real shingle sets."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import nearcopies, simhash  # noqa: E402


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(texts):
    ids, sets = sorted(texts), {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_dedup_links_are_those_of_real_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = roots({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs).collect()} == want
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(want.values())


def test_a_large_key_of_texts_that_differ_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SMALL", 4)
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    # a ladder: neighbours are near, the ends are not
    texts = {k: " ".join(base[4 * k :] + [f"x{i}" for i in range(4 * k)]) for k in range(40)}
    texts |= {100 + k: " ".join(base[:120] + [f"y{k}z{i}" for i in range(80)]) for k in range(30)}
    df = spark.createDataFrame([*texts.items(), (500, ""), (501, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(df).collect()}
    assert got == roots({**texts}) | {500: 500, 501: 500}


def test_prints_and_nearest_pivots_equal_plain_ones():
    of = nearcopies.shingles(" ".join(f"w{i}" for i in range(40)))
    lead = nearcopies.leads(of)
    bits = []
    for h in of.tolist():  # the hash of each shingle, word by word
        row = []
        for x, times in zip(nearcopies._XOR.tolist(), nearcopies._TIMES.tolist()):
            v = (h ^ x) * times % 2**64
            v = (v ^ v >> 32) * times % 2**64
            v ^= v >> 32
            row += [v >> i & 1 for i in range(64)]
        bits.append(row)
    bits = np.array(bits)
    words = nearcopies.prints(lead[None])[0].view(np.uint64)
    assert [int(w) >> i & 1 for w in words for i in range(64)] == (2 * bits.sum(axis=0) > len(of)).astype(int).tolist()
    pivots = nearcopies.references() > 0
    for g, got in enumerate(nearcopies.nearest(lead[None])[0][:8]):
        to = [int((bits != pivots[:, g * nearcopies.PIVOTS + p]).sum()) for p in range(nearcopies.PIVOTS)]
        reach = [*to, *(bits.size - x for x in to)]  # the complements follow
        assert reach[got] == min(reach)


def test_pivots_bring_together_nearly_all_pairs_of_least_similarity():
    rng = np.random.default_rng(5)
    for common, own, other in ((4, 1, 0), (8, 1, 1), (80, 10, 10), (240, 60, 0)):
        sets = [rng.integers(0, 2**64, size=common + own + other, dtype=np.uint64) for _ in range(300)]
        a = np.stack([nearcopies.leads(x[: common + own]) for x in sets])
        b = np.stack([nearcopies.leads(np.append(x[:common], x[common + own :])) for x in sets])
        met = (nearcopies.keys(nearcopies.nearest(a)) == nearcopies.keys(nearcopies.nearest(b))).any(axis=1)
        apart = np.bitwise_count((nearcopies.prints(a) ^ nearcopies.prints(b)).view(np.uint64)).sum(axis=1)
        assert met.sum() >= 299 and apart.max() <= nearcopies.RADIUS
        unlike = (nearcopies.prints(a[1:]) ^ nearcopies.prints(a[:-1])).view(np.uint64)
        assert np.bitwise_count(unlike).sum(axis=1).min() > nearcopies.RADIUS


def test_a_gap_of_pivot_distances_parts_a_key(spark):
    far = nearcopies.RADIUS + 1
    rows = [(1, 10, 0), (1, 11, far - 1), (1, 12, 2 * far - 1), (1, 13, 2 * far), (2, 10, 0), (2, 14, far), (2, 15, far)]
    got = {(r["k"], r["fp"]): r["cell"] for r in nearcopies._cells(spark.createDataFrame(rows, "k long, fp long, d long")).collect()}
    assert got == {(1, 10): 0, (1, 11): 0, (1, 12): 1, (1, 13): 1, (2, 10): 0, (2, 14): 1, (2, 15): 1}


def test_rows_of_one_key_meet_across_batches():
    rows = [(1, 4), (2, 3), (2, 5), (2, 6), (2, 7), (3, 1), (4, 2), (4, 9)]
    for size in range(1, 9):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*p)], ["k", "fp"]) for p in parts]
        got = [tuple(r.values()) for b in nearcopies._meeting(iter(batches)) for r in b.to_pylist()]
        assert got == [(2, 3, 3), (2, 5, 3), (2, 6, 3), (2, 7, 3), (4, 2, 2), (4, 9, 2)], size


def test_near_copies_are_discarded_by_their_fingerprints(spark, monkeypatch):
    """What lies beyond the radius is not linked, so the fingerprints, not another path, bring pairs to the texts."""
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"]))], "doc_id long, text string")
    assert {r["component_id"] for r in nearcopies.groups(df).collect()} == {1}
    monkeypatch.setattr(nearcopies, "RADIUS", -1)
    assert {r["component_id"] for r in nearcopies.groups(df).collect()} == {1, 2}


def alike(n, words=100, edits=2):
    """Texts of one base with a few words changed: most pairs lie just under the least similarity, some above."""
    rng = np.random.default_rng(3)
    out = {}
    for k in range(n):
        of = [f"w{i}" for i in range(words)]
        for i in rng.integers(0, words, edits):
            of[i] = f"e{k}x{i}"
        out[k] = " ".join(of)
    return out


@pytest.mark.parametrize("block", [256, 32])
def test_texts_just_under_the_least_similarity_are_no_table_of_pairs(spark, monkeypatch, block):
    made, saved = {}, nearcopies.saved

    def counted(df, name):
        out = saved(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(nearcopies, "saved", counted)
    monkeypatch.setattr(nearcopies, "SMALL", 512)  # as rows of a join, all pairs would show
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = alike(200)
    want = roots(texts)
    assert 10 < len(set(want.values())) < 190
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == want
    assert made["shared"] > 200  # keys: rows, not pairs
    assert {name: n for name, n in made.items() if n > max(2 * 200, made["shared"])} == {}
    assert made["second"] <= 200


def test_only_texts_of_groups_are_shuffled(spark, monkeypatch, capsys):
    docs = spark.createDataFrame([(k, f"text {k % 50}") for k in range(200)], "doc_id long, text string")
    fps = spark.createDataFrame([(nearcopies._words("text 7"),), (nearcopies._words("text 9"),)], "fp long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for prints, join in ((0, "SortMergeJoin"), (2, "BroadcastHashJoin")):
            monkeypatch.setattr(nearcopies, "HOT_PRINTS", prints, raising=False)
            found = nearcopies._texts(docs, fps)
            assert sorted(r["text"] for r in found.collect()) == ["text 7", "text 9"]
            capsys.readouterr()
            found.explain()
            assert join in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_common_shingles_of_all_pairs_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(nearcopies, "WIDE", 7)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, size=n).astype(np.uint64)) for n in (0, 1, 5, 20, 40, 0, 60, 3)]
    first, second = np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7])
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in second] for i in first]
    assert nearcopies._shared_shingles(sets, first, second).tolist() == want
    assert nearcopies._shared_shingles([sets[0], sets[5]], np.array([0]), np.array([1])).tolist() == [[0]]


def test_each_pair_across_components_is_in_one_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    rows = [(1, k, 0) for k in range(13)] + [(1, k, 20) for k in range(20, 29)] + [(1, k, 30) for k in range(30, 33)] + [(1, k, k) for k in range(40, 50)]
    rows += [(2, k, 100) for k in range(100, 120)]  # of one component: no pairs
    rows += [(3, k, k) for k in range(200, 206)]
    tasks = {}
    for r in nearcopies._in_blocks(spark.createDataFrame(rows, "g long, fp long, c long")).collect():
        tasks.setdefault((r["g"], r["a"], r["b"]), []).append((r["fp"], r["c"], r["block"]))
    met = {}
    for (g, a, b), of in tasks.items():
        for fp, c, block in of:
            for fp2, c2, block2 in of:
                if c != c2 and (block, block2) == (a, b) and (a != b or fp < fp2):
                    key = (g, min(fp, fp2), max(fp, fp2))
                    met[key] = met.get(key, 0) + 1
    assert met == {(g, f, f2): 1 for g, f, c in rows for g2, f2, c2 in rows if g == g2 and f < f2 and c != c2}
    assert all(not a.startswith("0:") or not b.startswith("0:") for g, a, b in tasks if g == 1)
