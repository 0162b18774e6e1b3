"""Filter interaction audit, Merkle manifest and n-gram Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import filteraudit, jaccardjoin, merkle

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter interaction audit

def brute_masks(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 bool(re.search(r"[#$%&*|]", text)),
                 doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)]
        out.append((lang or "", doc_id, fails))
    return out


def brute_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    masks, out = brute_masks(rows), []
    for part in {p for p, _, _ in masks}:
        own = [(i, dict(zip("ABCDE", fails, strict=True))) for p, i, fails in masks if p == part]
        share, steps = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if x[1][letter]], [x for x in left if not x[1][letter]]
                share[letter] += len(gone)
                steps.append(("".join(order), step, len(left), len(gone), sum(f[letter] for _, f in own) - len(gone),
                              sum(f[letter] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(part, *s, share[s[0][s[1] - 1]]) for s in steps]
    return out


def audit_rows(rng, n):
    def text():
        kind = rng.random()
        if kind < 0.15:
            return rng.choice([None, "", "  \n\t ", "same", "#", "É\x1cÀ"])
        words = [rng.choice(["a", "B", "c#", "dé", "E|", "f"]) if kind < 0.4 else f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 199, 200, 260]))]
        return rng.choice([" ", "\t", "\n"]).join(words) + rng.choice(["", " AAAA", "\x0b"])
    texts = [text() for _ in range(n // 2)]
    rows = [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    return [*rows, *rows[:5]]


def test_audit_is_that_of_brute_force(spark):
    rng = random.Random(4)
    rows = audit_rows(rng, 60)
    labels = [(rng.choice([None, i]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(70)] + [(3, 1, 0), (3, 0, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, mask int, part string, n int")
    got = filteraudit.interaction_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *filteraudit.FIGURES, "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(rows, labels))


def test_audit_of_nothing_and_of_one(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filteraudit.interaction_audit(docs, labels).count() == 0
    one = filteraudit.interaction_audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels)
    assert sorted(map(tuple, one.collect())) == sorted(brute_audit([(1, None, None)], []))


def test_recursion_covers_every_prefix_once(spark):
    cells = spark.createDataFrame([("p", m, 1, 0, 0) for m in range(16)], "part string, mask int, n long, good long, toxic long")
    steps = filteraudit.prefix_steps(cells, "ABCD").collect()
    want = {"".join(p) for k in range(1, 5) for p in itertools.permutations("ABCD", k)}
    assert len(steps) == len(want) and {s.prefix for s in steps} == want
    assert all(s.kept == 16 >> s.step and s.removed == 16 >> s.step and s.unique_fails == 1 for s in steps)


# --- Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_way(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((j > i, level[j]) if j < len(level) else None)
        i >>= 1
    return out


def brute_proofs(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[lang] = own, brute_levels([brute_leaf(r) for r in own])
    whole, out = brute_levels([trees[x][1][-1][0] for x in langs]) if rows else None, []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, row in enumerate(own):
            way = brute_way(levels, i) + brute_way(whole, k)
            tampered = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = brute_leaf(row, 1) if tampered else levels[0][i]
            for step in way:
                node = sha(node) if step is None else sha(node + step[1]) if step[0] else sha(step[1] + node)
            root = whole[-1][0]
            out.append((row[0], levels[0][i], levels[-1][0], root, sha("".join(s[1] for s in way if s)), node, node == root))
    return out


def by_text(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize(("n", "block_levels"), [(0, 3), (1, 3), (2, 1), (9, 1), (60, 2), (300, 3), (300, 10)])
def test_proofs_are_those_of_brute_force(spark, n, block_levels):
    rng = random.Random(n)
    rows = [(rng.choice([None, i, i // 3]), rng.choice(["a", None]), rng.choice(["en", "en", "fr", None, "", "é", "zz"]),
             rng.choice([None, i, 2**63 - 1]), rng.choice(["t", "", None, "xé\n"])) for i in range(n)]
    rows += rows[: n // 3] + rows[:1] * (n // 2)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, leaf string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    assert by_text(merkle.proofs(docs, tampered, block_levels).collect()) == by_text(brute_proofs(rows))


@pytest.mark.parametrize("levels", range(1, 12))
def test_addresses_are_a_van_emde_boas_layout(levels):
    def laid(root, depth, height):  # (depth, index) of a subtree in order, by definition
        if height == 1:
            return [(depth, root)]
        upper = height // 2
        out = laid(root, depth, upper)
        for child in range(root << upper, (root + 1) << upper):
            out += laid(child, depth + upper, height - upper)
        return out
    want = {node: at for at, node in enumerate(laid(0, 0, levels))}
    for depth in range(levels):
        assert merkle.address(levels, depth, np.arange(1 << depth)).tolist() == [want[depth, i] for i in range(1 << depth)]


def test_numbers_spread_a_value_that_many_rows_share(spark):
    rows = spark.range(0, 4000, numPartitions=8).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("v"))
    got = merkle.numbered(rows, "v")
    assert [r.v for r in got.orderBy("pos").collect()] == sorted(r.v for r in rows.collect())
    assert sorted(r.pos for r in got.collect()) == list(range(4000))


# --- n-gram Jaccard join

def brute_set(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 3]) for i in range(max(len(words) - 2, 1))) if words else frozenset()


def brute_join(rows, percent=90):
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[top(i)] = min(doc_id, ids.get(top(i), math.inf))
    return [(doc_id, len(s), ids.get(top(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_texts(rng):
    texts = [None, "", " \t\n", "one", "One", "two words", "two  words", "three little words", "Ünï ünï Ünï ünï"]
    for size in (9, 10, 11, 12, 21, 22, 60, 200):  # edges of the bounds: one word more, one word changed
        base = [f"b{size}w{i}" for i in range(size)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(["less", *base]), " ".join(base[:-1]), " ".join(base).upper()]
        texts += [" ".join([*base[:k], "x", *base[k + 1:]]) for k in (0, size // 2, size - 1)]
    for _ in range(6):  # groups around one text, with edits below and above the bound
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(40, 150))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"z{rng.randint(0, 10**6)}"
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    passage = [f"p{i}" for i in range(50)]  # stands in many texts that are not alike
    texts += [" ".join(passage + [f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 60))]) for _ in range(40)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_the_components_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = near_texts(rng)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[12]), (None, "alone without an id"), (ids[0], texts[20]), (ids[3], texts[3]), (ids[3], texts[3])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, row string, tokens int").repartition(5)
    assert by_text(jaccardjoin.near_sets(docs).collect()) == by_text(brute_join(rows))


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccardjoin.near_sets(empty).count() == 0
    assert by_text(jaccardjoin.near_sets(spark.createDataFrame([(4, None), (2, " ")], empty.schema)).collect()) == by_text([(4, 0, 4), (2, 0, 2)])


def test_shingles_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abÉ", k=rng.randint(1, 9))) for _ in range(400))
    whole = jaccardjoin.shingles(text)
    monkeypatch.setattr(jaccardjoin, "PIECE", 64)
    assert np.array_equal(jaccardjoin.shingles(text), whole) and len(whole) == len(brute_set(text))


def test_join_rows_grow_with_a_group_and_not_with_its_square(spark):
    base = [f"w{i}" for i in range(200)]

    def pairs(n):
        docs = spark.createDataFrame([(i, " ".join([*base, f"own{i}"])) for i in range(n)], "doc_id long, text string")
        sets = jaccardjoin.token_sets(docs)
        heads = jaccardjoin.distinct_sets(sets)
        lists = jaccardjoin.prefix_lists(sets, heads, 90)
        stars = jaccardjoin.verified(jaccardjoin.star_pairs(lists, 90), docs, sets, heads, 90)
        return stars.count(), jaccardjoin.open_pairs(lists, jaccardjoin.components(stars), 90).count()
    assert pairs(40) == (39, 0)
    assert pairs(120) == (119, 0)
