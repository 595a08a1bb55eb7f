"""Each operator against a brute-force version on small tables."""

import binascii
import hashlib
import re

import numpy as np
import pytest
import xxhash

pytest.importorskip("corvane.llm")

import public_tokenizers  # noqa: E402

from corvane.llm import chat, editembed, html_extract, htmlblocks, linededup, packing, pieces, pii, quality, sharding, simhash, wordcache  # noqa: E402

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def base(t):
    """The base spans by the plain patterns."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    cards = [(m, re.sub("[ -]", "", m.group())) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)]
    out += [(m.start(), m.end(), "card") for m, d in cards if 12 <= len(d) <= 19 and sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(d))) % 10 == 0]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_pii_base_is_exact(docs, texts):
    got = by_id(pii.report(docs))
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = base(t)
        assert got[d]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, b, k in want))
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(got[d]["spans"].split(","))
        assert [got[d][f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in want) for k in pii.BASE]


def test_pii_base_on_odd_texts():
    r = np.random.default_rng(3)
    trees, limits = pii.model()
    for _ in range(3000):
        t = "".join(r.choice(list("a1.@+- 0259()-xé25"), int(r.integers(0, 60))))
        assert pii.find(t, trees, limits)[0] == base(t), t
    for t in ("a@b.c@d.e", "1.2.3.4.5.6.7.8", "0000000255.1.1.1", "4111 1111 1111 1111", "@" * 50, "1" * 3000, "é@a.b", "x@-.-"):
        assert pii.find(t, trees, limits)[0] == base(t)


def test_pii_model_on_held_out_examples():
    trees, limits = pii.model()
    rows, y = pii.examples(1000, 77)
    x = np.array([pii.describe(*r) for r in rows])
    chosen = trees.chance(x) >= limits[x[:, 0].astype(int)]
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.6


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now", "en"), (2, None, "de")], "doc_id long, text string, lang string")
    got = by_id(pii.redact(df))
    assert got[1]["text"] == "mail [EMAIL] now" and got[2]["text"] is None and got[2]["lang"] == "de"


def brute_lines(rows):
    """rows: list of (doc_id, text); what stays of each row."""
    key = lambda x: x.strip(WHITE).translate(LOWER)
    held = {}
    for i, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), [])) < 5 or d == max((rows[i][0] for i in held[key(x)] if rows[i][0] is not None), default=None)]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return sorted(out, key=repr)


def test_line_dedup(docs, texts):
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.report(docs).collect()), key=repr)
    assert got == brute_lines(list(texts.items()))
    assert sum(r[2] for r in got) > 0


def test_line_key_lowers_ascii_only(spark):
    long = "x" * 40
    rows = [("É" + long,), ("é" + long,), ("A" + long,), ("a" + long,), ("İ" + long,), ("ß" + long,), ("SS" + long,)]
    from pyspark.sql import functions as F

    keys = [r[0] for r in spark.createDataFrame(rows, "t string").select(linededup.line_key(F.col("t"))).collect()]
    assert keys[2] == keys[3] and len({tuple(k) for k in keys}) == 6


def test_runs_merge_and_anti_join(spark):
    runs = linededup.Runs(fan=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(10 * b + i, i % 3, 0) for i in range(6)], "doc_id long, k1 long, k2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["k1"], r["n"], r["last"]) for r in runs.merged().collect()} == {(0, 10, 43), (1, 10, 44), (2, 10, 45)}
    new = spark.createDataFrame([(1, 1, 0), (2, 9, 0)], "doc_id long, k1 long, k2 long")
    assert [r["k1"] for r in runs.unseen(new).collect()] == [9]


def brute_simhash(t, words=4):
    w = t.translate(LOWER).split(" ")
    w = [x for x in re.split("[\x20\x09-\x0d]+", t.translate(LOWER)) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash(docs, texts):
    got = by_id(simhash.report(docs))
    prints = {d: brute_simhash(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("hot, radius, agree", [(4096, 4, 2), (8, 4, 2), (4096, 8, 3), (16, 8, 3)])
def test_simhash_edges_on_dense_prints(spark, monkeypatch, hot, radius, agree):
    """Chains and balls of near fingerprints, with keys below and above the size of a block."""
    r = np.random.default_rng(1)
    centres = [int(x) for x in r.integers(0, 2**63, 6)]
    prints = set(centres)
    for c in centres[:3]:
        for _ in range(40):
            x = c
            for b in r.choice(64, int(r.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    x = centres[5]
    for b in range(0, 60, 4):
        x ^= 0b1111 << b
        prints.add(x)
    prints = {i: p for i, p in enumerate(sorted(prints))}
    monkeypatch.setattr(simhash, "HOT", hot)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints.values()]
    fps = spark.createDataFrame(signed, "fp long")
    found = simhash.components(simhash.near_edges(fps, radius, agree))
    root = {r["node"]: r["root"] for r in found.collect()}
    got = {}
    for i, (s,) in enumerate(signed):
        got.setdefault(root.get(s, s), set()).add(i)
    want = {}
    for i, c in brute_components(prints, radius).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edit_embedding(docs, texts):
    got = by_id(editembed.report(docs))
    ids = sorted(texts, reverse=True)
    for d, nxt in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[d], texts[nxt]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), sha(e))
        a, b, c = editembed.fingerprints([t])[0], editembed.fingerprints([e])[0], editembed.fingerprints([n])[0]
        assert got[d]["fingerprint"] == a.tobytes().hex() and got[d]["edited_fingerprint"] == b.tobytes().hex()
        assert got[d]["near_edited"] == pytest.approx((a == b).mean()) and got[d]["near_next"] == pytest.approx((a == c).mean())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in got.values()])


def test_edit_embedding_walks_alike_alone_and_side_by_side(texts):
    some = list(texts.values())[:120]
    together = editembed.fingerprints(some)
    assert all((editembed.fingerprints([t])[0] == f).all() for t, f in zip(some, together))


def test_edit_embedding_keeps_near_texts_near(spark, texts):
    r = np.random.default_rng(2)
    rows = []
    for t in [t for t in texts.values() if len(t) > 400][:60]:
        at = int(r.integers(0, len(t) - 5))
        rows += [t, t[:at] + "Q" + t[at + 2 :]]
    prints = [(i, p.tobytes()) for i, p in enumerate(editembed.fingerprints(rows))]
    of = {r["doc_id"]: r["class_id"] for r in editembed.classes(spark.createDataFrame(prints, "doc_id long, fingerprint binary"), 0.7).collect()}
    near = [of[i] == of[i + 1] for i in range(0, len(prints), 2)]
    assert np.mean(near) > 0.9


def test_chat(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = by_id(chat.report(df, public_tokenizers.path("byte_bpe_50k.json")), "conv_id")
    rows = {-1: [("user", chat.PROBE), ("assistant", chat.PROBE)]}
    for r in df.orderBy("conv_id", "turn", "role", "text").collect():
        rows.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(rows)
    for c, turns in rows.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        printed = "".join(f"<|im_start|>{r}\n{chat.escape(t)}<|im_end|>\n" for r, t in turns)
        assert got[c]["formatted_chars"] == len(printed)


def test_chat_round_trip_of_hostile_texts():
    t = chat.template(public_tokenizers.path("byte_bpe_50k.json"))
    r = np.random.default_rng(4)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "\\", "<", "|", "im_end|>", "\n", "assistant", "é", "😀", "<|endoftext|>", " "]
    for _ in range(200):
        turns = [(str(r.choice(["user", "assistant", "a\nb", "<|im_end|>", ""])), "".join(r.choice(bits, int(r.integers(0, 9))))) for _ in range(3)]
        ids, mask = t.assemble(turns)
        assert [(a, b) for a, b, _ in t.read(ids, mask)] == turns
        assert "".join(u for _, _, u in t.read(ids, mask)) == "".join(x for a, x in turns if a == "assistant")
        shown = t.printed(ids)
        assert shown.count("<|im_start|>") == 3 == shown.count("<|im_end|>")


def check_packing(rows, texts, window=2048):
    tok = wordcache.WordIds(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    ids = {d: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    seen, where = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and len(part) == r["length"] and r["ids_crc32"] == binascii.crc32(part.tobytes())
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in ids.items():
        at = 0
        for s, n in sorted(seen[d]):
            assert s == at
            at += n
        assert at == len(own)
    used = 0
    for parts in where.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
        used += window if at & (at - 1) else at
    return sum(map(len, ids.values())) / used


def test_packing(docs, texts):
    assert check_packing(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), texts) > 0.95


def test_packing_plan_places_every_rest_once():
    r = np.random.default_rng(0)
    for high in (60, 900, 2047):
        lengths = np.clip(r.exponential(high / 2, 30_000).astype(int) + 1, 1, 2047)
        histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
        p = packing.plan(histogram)
        fill = {}
        for n, ranges in p.arrays().items():
            at = 0
            for first, many, window, each in ranges.tolist():
                assert first == at
                at += many
                for k in range(many):
                    fill[window + k // each] = fill.get(window + k // each, 0) + n
            assert at == histogram[n]
        assert max(fill.values()) <= 2048 and set(fill) == set(range(p.windows))
        assert sum(fill.values()) / (2048 * p.windows) > 0.985


def test_nnls_meets_its_conditions():
    r = np.random.default_rng(5)
    for _ in range(10):
        a, b = r.random((12, 30)), r.random(12)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and g.max() < 1e-6 and abs(g[x > 1e-9]).max(initial=0) < 1e-6


def test_word_ids_equal_whole_texts(texts):
    w = wordcache.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", "\x01", " \x01 a", "a\x01b", "é\u0301x \u0301\t y", "'s don't 'll", "İstanbul ΣΑΣ", "\n\n a\n", "<|endoftext|>", "a\u00a0b\u2003c"]
    all_texts = list(texts.values())[:60] + odd
    assert w.of(all_texts, 2000) == [np.array(e.ids, "<u4").tobytes() for e in w.tokenizer.encode_batch(all_texts, add_special_tokens=False)]


def test_sharding(docs, texts):
    got = by_id(sharding.assign(docs))
    assert set(got) == set(texts) and {r["law"] for r in got.values()} == {"key"}
    for d, t in texts.items():
        assert got[d]["size"] == len(t.encode()) + 1 and got[d]["text_crc32"] == binascii.crc32(t.encode())
        assert got[d]["grown_shard"] in (got[d]["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_hash_tree_spreads_by_weight_and_confines_movement(spark):
    from pyspark.sql import functions as F

    key = F.col("id").cast("string")
    heavier = sharding.tree(8, {5: 3.0})
    rows = spark.range(40_000).select(sharding.place(key, sharding.tree(8)).alias("a"), sharding.place(key, sharding.tree(9)).alias("b"), sharding.place(key, heavier).alias("c")).collect()
    counts = np.bincount([r["a"] for r in rows], minlength=8)
    assert abs(counts / 5000 - 1).max() < 0.08
    assert {r["b"] for r in rows if r["b"] != r["a"]} == {8} and 0.09 < np.mean([r["b"] == 8 for r in rows]) < 0.13
    assert all(r["c"] >= 4 for r in rows if r["a"] >= 4) and 0.27 < np.mean([r["c"] == 5 for r in rows]) < 0.33


def brute_quality(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    win = {}
    for i in range(len(w) - 4):
        win.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in win.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts(docs, texts):
    got = by_id(quality.judge(docs))
    for d, t in texts.items():
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t), d
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_and_rejects_bad(spark):
    d = "/root/testdata/sf0.01"
    got = by_id(quality.judge(spark.read.parquet(f"{d}/documents.parquet")))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = [got[i]["kept"] for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_quality_estimates_known_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.7
    rate = [0.95, 0.9, 0.85, 0.9, 0.8, 0.9, 0.95, 0.7]
    votes = [np.where(r.random(20_000) < a, truth, ~truth) * 2 for a in rate]
    patterns, n = np.unique(sum(v * 3**k for k, v in enumerate(votes)), return_counts=True)
    prior, weights = quality.estimate(list(zip(patterns.tolist(), n.tolist())))
    z = prior + sum(np.array(w)[v] for w, v in zip(weights, votes))
    assert ((z > 0) == truth).mean() > 0.985 and abs(1 / (1 + np.exp(-prior)) - 0.7) < 0.02


def test_pieces_equal_the_library(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path)
    r = np.random.default_rng(1)
    odd = ["", " ", "a", "  a", "a   b    c", "     " * 7, "\n", " \n b\n\n", "\u2581a \u2581\u2581b", "日本語 テキスト", "😀 x\x00y\t\tz", "<s> <0x41> </s>", "if x:\n        return  y\n            z"]
    odd += ["".join(r.choice(list("abcdeinorst  \n.,éüñ\u2581013'-ABTH"), int(r.integers(1, 40)))) for _ in range(500)]
    for x in [*odd, *list(texts.values())[:40]]:
        ids = t.encode(x)
        assert ids.tolist() == sp.encode(x), x
        assert t.decode(ids) == sp.decode(ids.tolist())
    got = by_id(pieces.report(docs, path))
    for d, x in texts.items():
        ids = np.array(sp.encode(x), "<u4")
        assert (got[d]["n_pieces"], got[d]["ids_crc32"], got[d]["decoded_sha256"]) == (len(ids), binascii.crc32(ids.tobytes()), sha(x))


def test_html_labeller_on_held_out_pages():
    xs, ys = html_extract.examples(150, 99)
    lstm = html_extract.model()
    right = [(lstm.chance(x[None], np.ones((1, len(x)), bool))[0] >= 0.5) == (y > 0.5) for x, y in zip(xs, ys)]
    assert np.mean(np.concatenate(right)) > 0.99


def test_html_text_of_given_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = by_id(html_extract.report(df), "page_id")
    for r in df.collect():
        want = "\n".join(b.text() for b in htmlblocks.blocks(r["html"] or "") if "article" in b.path)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_html_blocks():
    page = "<p>a&amp;b <b>c\n d</b><br>e<p>f<script>x('<p>')</script>g<!-- h --><div>i<span>j</span></div>k<ul><li>l<li>m</ul><foot"
    assert [b.text() for b in htmlblocks.blocks(page)] == ["a&b c d e", "fg", "ij", "k", "l", "m"]
    assert [b.linked for b in htmlblocks.blocks("<p>x <a href='y'>abc</a></p>")] == [3]
    assert htmlblocks.blocks("") == [] and [b.text() for b in htmlblocks.blocks("<<p>1 < 2</p>")] == ["<", "1 < 2"]
