"""SimHash, components, top-k, sharding, chat pairs and the two classifiers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import chat, quality, sharding, simhash, topk, toxicity
from ledgerline.llm.components import components


def brute_fingerprint(text, k):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(max(len(words) - k, 0) + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints, distance):
    keys = sorted(prints)
    label = {k: k for k in keys}
    for _ in keys:
        for a in keys:
            for b in keys:
                if bin(prints[a] ^ prints[b]).count("1") <= distance:
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_fingerprints(spark, odd_docs):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["Aa", "b", "ÉC", "d d", "e\tE"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 30, 700)]
    got = simhash.fingerprints(odd_docs([*texts, "one", " \t "])).join(odd_docs([*texts, "one", " \t "]).select("doc_id", "text").distinct(), "doc_id")
    for r in got.collect():
        assert r.fp & (2**64 - 1) == brute_fingerprint(r.text, 4), r.text


def dense_prints(rng, n):
    base = [rng.getrandbits(64) for _ in range(5)] + [0, 2**64 - 1]
    out = set(base)
    while len(out) < n:
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << b
        out.add(x if rng.random() < 0.7 else rng.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize(("distance", "node_rows"), [(4, 8192), (4, 16), (2, 8192), (0, 8192)])
def test_trie_join_finds_the_components_of_all_pairs(spark, monkeypatch, distance, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    monkeypatch.setattr(simhash, "FRONTIER", 512)
    prints = dense_prints(random.Random(distance), 260)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.print_links(table, distance).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") > 0 for a, b in links)
    root = {r.vertex: r.root for r in components(simhash.print_links(table, distance)).collect()}
    got = {}
    for p, s in zip(prints, signed, strict=True):
        got.setdefault(root.get(s, s), set()).add(p)
    want = {}
    for p, r in brute_components({p: p for p in prints}, distance).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_more_runs_find_the_same(spark):
    prints = dense_prints(random.Random(9), 300)
    for n in (300, 10**9, 10**12):
        masks = simhash.run_masks(n, 4)
        assert len(masks) == len(set(masks))
        for a in prints[:40]:
            for flips in ((), (0,), (1, 17, 33, 63), (60, 61, 62, 63)):
                b = a ^ sum(1 << f for f in flips)
                assert any((a ^ b) & (m & (2**64 - 1)) == 0 for m in masks)


def test_near_duplicates_keep_one_of_each_group(spark, odd_docs):
    rng = random.Random(4)
    body = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(50)) for _ in range(400)) for _ in range(4)]
    near = [b + " tail" for b in body]
    docs = odd_docs([*body, *near, "one", "One", "two words"])
    rows = docs.collect()
    prints = {i: brute_fingerprint(r.text, 4) for i, r in enumerate(rows)}
    label = brute_components(prints, 4)
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(least.get(label[i], 10**9), 10**9 if r.doc_id is None else r.doc_id)
    got = simhash.near_duplicates(docs)
    assert sorted(str((r.doc_id, r.fp & (2**64 - 1), r.component_id)) for r in got.collect()) == sorted(
        str((r.doc_id, prints[i], least[label[i]])) for i, r in enumerate(rows))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(100, 140)] + [(7, 7)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([1000, *range(100, 140)], 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "huge"])
def test_top_k_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(5)
    data = rng.normal(0, 0.2, (150, 12))
    if kind == "sparse":
        data[rng.random(data.shape) < 0.85] = 0
    if kind == "ties":
        data = np.where(rng.random((150, 1)) < 0.4, 0.25, np.round(data))
    if kind == "huge":
        data = data * 1e5
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(200, None), (250, [1.0, None]), (300, [float("nan")] * 12), (None, [1.0] * 12), (350, [float("inf")] * 12), (400, [])]
    table = spark.createDataFrame([(*r, 3) for r in rows + odd], "vec_id long, embedding array<double>, score int")
    vectors = topk.integer_vectors(table)
    got = topk.top_k(vectors.where("vec_id % 25 = 0"), vectors, 5)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows] + [(400, [])]
    want = brute_top(whole, [r for r in whole if r[0] % 25 == 0], 5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_top_k_of_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(table)
    got = topk.top_k(vectors.where("vec_id = 0"), vectors, 5)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1, -65536), (0, 2, 1, -65536)]
    assert topk.top_k(vectors.limit(0), vectors, 5).count() == 0
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0


def test_shard_table_is_even_and_stable():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 701)
    counts = np.bincount(table, minlength=7)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 701)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 701
    for bad in (700, 1, sharding.MAX_SLOTS + 1):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 701)


def test_place_keeps_rows(spark, odd_docs):
    docs = odd_docs(["a", "b"])
    names = ["x", "y", "z"]
    got = sharding.place(docs, F.col("doc_id"), names, 101)
    table = sharding.lookup_table(names, 101)
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns == [*(c for c in docs.columns if c != "shard"), "slot", "shard"]
    for r in rows:
        slot = sharding._number("" if r.doc_id is None else str(r.doc_id)) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(docs.limit(0), F.col("doc_id"), names, 101).count() == 0


def test_preference_pairs(spark):
    turns = [("p", "chosen", 0, "user", "q"), ("p", "rejected", 0, "user", "q"), ("p", "chosen", 1, "assistant", "good"),
             ("p", "rejected", 1, "assistant", "b"), ("p", "chosen", 2, "user", None), ("p", "rejected", 2, "user", None), ("p", "other", 0, "user", "x"),
             ("same", "chosen", 0, "user", "q"), ("same", "rejected", 0, "user", "q"), ("half", "chosen", 5, None, "q"), ("half", "chosen", 5, None, "q"),
             (None, "chosen", None, "assistant", "é"), (None, "rejected", None, "assistant", "")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(turns, "pair_id string, side string, turn int, role string, text string")).collect()}
    p = got["p"]
    assert p.n_prompt_turns == 1 and p.prompt == "<|turn|>user\nq<|end|>\n"
    assert p.chosen == "<|turn|>assistant\ngood<|end|>\n<|turn|>user\n<|end|>\n"
    assert [p.chosen[s["from"]:s["to"]] for s in p.chosen_spans] == ["good"]
    assert [p.rejected[s["from"]:s["to"]] for s in p.rejected_spans] == ["b"]
    assert (got["same"].n_prompt_turns, got["same"].chosen, got["same"].rejected) == (1, "", "")
    assert (got["half"].n_prompt_turns, got["half"].prompt, got["half"].rejected) == (0, "", "")
    assert got["half"].chosen.count("<|turn|>") == 2
    assert [got[None].chosen[s["from"]:s["to"]] for s in got[None].chosen_spans] == ["é"]


def classified(spark, n):
    rng = random.Random(n)
    bad, fine = ["vile", "rotten"], [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        body = [rng.choice(fine) for _ in range(rng.randint(20, 80))]
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(bad)
        rows.append((i, " ".join(body) + ("." if good else " $$$ ### !!!" * 6), 1, "c"))
        marks.append((i, int(good), int(toxic)))
    rows += [(n, None, 1, "c"), (n + 1, "", 1, "c"), (None, "w1 vile", 1, "c"), (0, rows[0][1], 1, "c"), (n + 2, "w1 " * 300_000 + "vile", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    odd = [(None, 1, 1), (1, None, None), (2, 7, 7), (3, marks[3][1], marks[3][2])]
    return docs, spark.createDataFrame(marks[: n // 2] + odd, "doc_id long, quality int, toxic int"), marks


def test_toxicity_bounds_each_class_of_the_documents_there(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_ROWS", 50)
    docs = spark.createDataFrame([(i, f"a{i} " + ("vile" if i % 100 == 7 else "fine")) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 100 == 7)) for i in range(12_000)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels).collect()
    assert sum(r.label for r in got) == 40 and len(got) == 90
    scored = toxicity.toxicity(docs, labels).where("predicted <> CAST(text LIKE '%vile' AS INT)")
    assert scored.count() == 0


def test_toxicity_learns_and_keeps_rows(spark):
    docs, labels, marks = classified(spark, 500)
    got = toxicity.toxicity(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.predicted for r in rows}
    held = marks[250:]
    assert sum(by[i] == t for i, _, t in held) / len(held) > 0.97
    assert by[502] == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted == 0}
    same = {(r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect()}
    assert same == {(r.doc_id, r.score) for r in rows}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_quality_learns_and_keeps_rows(spark):
    docs, labels, marks = classified(spark, 500)
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.predicted for r in rows}
    held = marks[250:]
    assert sum(by[i] == q for i, q, _ in held) / len(held) > 0.97
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"word{i % 97}é" for i in range(5000))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert np.array_equal(toxicity.features(text), whole)
    assert len(toxicity.features("a b c")) == 3 * 1 + 2 + 1 + 9 and len(toxicity.features(None)) == 0


def scalar_ftrl(rows, passes):
    """FTRL-proximal as its authors write it, a coordinate at a time; the last coordinate is the bias."""
    z, n = {}, {}

    def weight(i):
        if i != "bias" and abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        shrunk = z.get(i, 0.0) - (0.0 if i == "bias" else math.copysign(toxicity.L1, z[i]))
        return -shrunk / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + (0.0 if i == "bias" else toxicity.L2))

    def bias():
        return -z.get("bias", 0.0) / ((toxicity.BETA + math.sqrt(n.get("bias", 0.0))) / toxicity.ALPHA + toxicity.L2)
    for _ in range(passes):
        for x, label in rows:
            w = {i: weight(i) for i in x} | {"bias": bias()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, own in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * own, n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}, bias()


def test_fit_is_ftrl_of_the_scalar_form(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(250):
        toxic = rng.random() < 0.4
        rows.append((i, " ".join(rng.choice(["vile", "rotten"] if toxic and rng.random() < 0.3 else ["calm", "plain", "word", "text"]) for _ in range(20))))
        labels.append((i, int(toxic)))
    at, w, bias = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    want, want_bias = scalar_ftrl([(toxicity.features(t).tolist(), label) for (_, t), (_, label) in zip(rows, labels, strict=True)], toxicity.ROUNDS)
    assert len(want) > 5 and bias == pytest.approx(want_bias, rel=1e-3, abs=1e-4)
    got = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert all(got.get(i, 0.0) == pytest.approx(want.get(i, 0.0), rel=1e-2, abs=1e-3) for i in {*got, *want})


def test_newton_finds_the_minimum_of_the_pairs_loss():
    rng = np.random.default_rng(1)
    d = rng.normal(size=(300, 4)) + np.array([0.7, -0.4, 0.0, 0.1])
    w = quality.newton(d).tolist()

    def loss(w):  # how unlikely every preference is, and the ridge
        pairs = [math.log1p(math.exp(-sum(a * b for a, b in zip(row, w, strict=True)))) for row in d.tolist()]
        return sum(pairs) / len(pairs) + quality.RIDGE / 2 * sum(x * x for x in w)
    for i in range(4):
        for step in (1e-3, -1e-3):
            assert loss([x + step * (i == k) for k, x in enumerate(w)]) > loss(w)
    descended = [0.0] * 4
    for _ in range(400):  # plain gradient descent ends at the same place
        gradient = [quality.RIDGE * x for x in descended]
        for row in d.tolist():
            p = 1 / (1 + math.exp(sum(a * b for a, b in zip(row, descended, strict=True))))
            gradient = [g - p * x / len(d) for g, x in zip(gradient, row, strict=True)]
        descended = [x - 0.5 * g for x, g in zip(descended, gradient, strict=True)]
    assert descended == pytest.approx(w, abs=1e-3)


def test_every_label_teaches_quality_and_the_threshold_is_exact(spark, monkeypatch):
    """No bound on the ids that teach: each is in pairs, and the sums in Spark are those of all rows at once."""
    monkeypatch.setattr(quality, "MAX_ROWS", 8, raising=False)
    monkeypatch.setattr(quality, "SHARE_ROWS", 7)
    docs, labels, marks = classified(spark, 120)
    rows = quality.training_rows(docs, labels).collect()
    kinds = [q for _, q, _ in marks[:60]]
    assert sorted((r.label, r.place) for r in rows) == [(k, i) for k in (0, 1) for i in range(kinds.count(k))]
    frame = spark.createDataFrame([(r.label, r.place, r.x) for r in rows], "label int, place long, x array<double>")
    wide = 2 * len(quality.NAMES)
    for pairs_of in ({0: kinds.count(0), 1: kinds.count(1)},):
        d = np.array([r.d for r in quality.preference_pairs(frame, pairs_of, np.ones(wide)).collect()])
        assert len(d) == quality.PAIRS * max(pairs_of.values())
    mean, scale, w, threshold = quality.fit(docs, labels)
    x = quality.widened(np.array([r.x for r in rows]))
    assert mean == pytest.approx(x.mean(0), abs=1e-8) and scale == pytest.approx(x.std(0), abs=1e-7)
    assert w == pytest.approx(quality.newton((d / scale).astype(np.float32).astype(float)), abs=1e-4)
    assert threshold == pytest.approx(np.quantile((x - mean) / scale @ w, kinds.count(0) / 60), abs=1e-8)


def test_ranked_values_are_exact(spark):
    rng = random.Random(4)
    values = sorted([rng.choice([0.5, 1.0, rng.random() * 1e6, -rng.random()]) for _ in range(300)])
    scores = spark.createDataFrame([(v,) for v in values], "s double").cache()
    for rank in (0, 70, 149, 298):
        assert quality.ranked(scores, rank) == (values[rank], values[rank + 1])
    assert quality.ranked(scores, 299) == (values[-1], values[-1])


def test_scores_are_the_model_of_the_features(spark):
    docs, labels, _ = classified(spark, 200)
    mean, scale, w, threshold = model = quality.fit(docs, labels)
    for r in quality.score(docs.where("length(text) < 10000 OR text IS NULL"), model).collect():
        x = quality.features(r.text).tolist()
        s = sum((v - m) / c * k for v, m, c, k in zip(x + [v * v for v in x], mean, scale, w, strict=True)) - threshold
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, s)))), abs=1e-9)


def test_an_id_that_holds_a_third_of_the_rows_teaches_once(spark):
    rows = [(i, f"text {i} " + ("vile" if i % 2 else "calm")) for i in range(60)] + [(7, f"hot text {i} vile") for i in range(15)] + [(7, "hot text")] * 15
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    taught = toxicity.training_rows(docs, labels).collect()
    assert len(taught) == 60 and [r for r in taught if r.doc_id == 7][0].label == 1
    assert sorted(toxicity.training_rows(docs.repartition(2), labels).collect()) == sorted(taught)
    assert toxicity.toxicity(docs, labels).count() == quality.quality(docs, labels).count() == len(rows)
