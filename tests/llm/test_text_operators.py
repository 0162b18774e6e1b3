"""Decontamination, licence scans, line dedup and BPE against brute force on small tables."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, licenses, linededup

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER_TO_LOWER))


def brute_hits(text, items, size):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        for at in range(max(len(w) - size, 0) + 1 if w else 0):
            part = w[at:at + size]
            for i in range(len(own) - len(part) + 1):
                if own[i:i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, odd_docs):
    rng = random.Random(3)
    pool = "aa b Cc d é É ee f".split()
    body = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, body(rng.choice([1, 3, 5, 9]))) for i in range(12)] + [(12, None), (13, "..."), (2, "É é"), (11, body(6))]
    texts = [body(rng.randint(0, 60)) for _ in range(40)] + ["!" + body(30) + "?", "b " * 500, items[3][1].upper()]
    docs = odd_docs(texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark, window=4).select("doc_id", "n_words", "n_hit", "items")
    want = [(r.doc_id, *brute_hits(r.text, items, 4)) for r in docs.collect()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    clean = {str((r.doc_id, r.text)) for r in docs.collect() if not brute_hits(r.text, items, 4)[1]}
    kept = decontaminate.drop_contaminated(docs, benchmark, window=4)
    assert kept.columns == docs.columns
    assert {str((r.doc_id, r.text)) for r in kept.collect()} == clean


def test_decontamination_in_blocks_and_without_rows(spark, odd_docs, monkeypatch):
    docs = odd_docs(["x a b c y", "a b", "b c a b c"])
    benchmark = spark.createDataFrame([(1, "a b c"), (2, "c a"), (3, "y")], "item_id long, text string")
    one = sorted(map(str, decontaminate.contamination(docs, benchmark, 3).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 80)
    assert sorted(map(str, decontaminate.contamination(docs, benchmark, 3).collect())) == one
    empty = decontaminate.contamination(docs, benchmark.limit(0), 3)
    assert {r.n_hit for r in empty.collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), benchmark, 3).count() == 0


def test_decontamination_runs_no_python(spark, odd_docs):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.contamination(odd_docs(["a"]), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_license_matches(spark, odd_docs):
    text = "Intro.\nreleased UNDER the (mit) license!\nLicensed under the Apache License, Version 2.0. Really\nAll\n\nall rights, all rights reserved"
    docs = odd_docs([text, "All rights reserved", "no licence here\n" * 30])
    got = {(r.doc_id, r.place, r.license, round(r.dice, 4)) for r in licenses.license_matches(docs).collect()}
    assert (0, 1, "MIT", 1.0) in got and (0, 2, "Apache-2.0", round(14 / 15, 4)) in got
    assert (1, 0, "proprietary", 1.0) in got
    assert {g[0] for g in got} == {0, 1, None}
    assert licenses.license_matches(docs.limit(0)).count() == 0


def test_license_bigrams_count_as_often_as_both_have_them(spark):
    docs = spark.createDataFrame([(1, "a b a b a b")], "doc_id long, text string")
    got = licenses.license_matches(docs, 0.5, (("X", "a b a b"),)).first()
    assert got.dice == pytest.approx(2 * 3 / (5 + 3))


MIT = licenses.TEMPLATES[5][1]


def test_license_notices_over_and_inside_lines(spark):
    words_of = MIT.split(" ")
    wrapped = "\n".join(" ".join(words_of[i:i + 11]) for i in range(0, len(words_of), 11))
    rest = "\n".join(f"warranty clause number {i} goes on for some more words here" for i in range(9))
    gpl = licenses.TEMPLATES[9][1].split(" ")
    texts = [f"MIT License\n\nCopyright 2020 X\n\n{wrapped}\n\n{rest}", "Copyright 2020 X. All rights reserved.",
             f"code\n# {' '.join(gpl[:14])}\n# {' '.join(gpl[14:28])}\n# {' '.join(gpl[28:])}\nimport x\n" + "y = 1 + 2\n" * 40,
             "This project is licensed under the MIT License. All rights reserved.",
             "Released under the MIT License.", "all rights, all of them reserved", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[1]), (1, texts[1])], "doc_id long, text string")
    old = {(r.doc_id, r.license) for r in licenses.license_matches(docs).collect()}
    assert old == {(3, "MIT"), (4, "MIT")}
    got = sorted((str(r.doc_id), r.place, r.start, r.license) for r in licenses.license_notices(docs).where("start IS NOT NULL").collect())
    assert got == [("0", 4, 5, "MIT"), ("1", 0, 3, "proprietary"), ("2", 1, 1, "GPL"), ("3", 0, 8, "proprietary"), ("None", 0, 3, "proprietary")]


def brute_lines(rows, sites, keep_first):
    spread, first = {}, {}
    for doc, text, site in rows:
        for place, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" "):
                spread.setdefault(line, set()).update([site] if site is not None else [])
                key = (doc is None, doc or 0, place)
                first[line] = min(first.get(line, key), key)
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, None, 0))
            continue
        kept = [(p, x) for p, x in enumerate(text.split("\n"))
                if not (x.strip(" ") and len(spread[x]) >= sites and (not keep_first or first[x] != (doc is None, doc or 0, p)))]
        out.append((doc, "\n".join(x for _, x in kept), len(text.split("\n")) - len(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("sites", "keep_first"), [(1, True), (3, True), (3, False), (12, False)])
def test_line_dedup_matches_brute_force(spark, sites, keep_first):
    rng = random.Random(sites)
    pool = ["", " ", "tail", *(f"line {i}" for i in range(25))]
    rows = [(i, "\n".join(rng.choice(pool[: rng.choice([6, 28])]) for _ in range(rng.randint(1, 12))), f"s{rng.randrange(20)}") for i in range(80)]
    rows += [(80, None, "s1"), (81, "", "s2"), (82, "line 1\nline 1\nline 1", None), rows[5], (None, "line 2\nx", "s3")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, place int")
    got = linededup.remove_lines(docs, F.col("source"), sites, keep_first)
    assert got.columns == [*docs.columns, "_llm_removed"]
    assert sorted(str((r.doc_id, r.text, r._llm_removed)) for r in got.collect()) == brute_lines(rows, sites, keep_first)


def test_line_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert linededup.remove_lines(docs, F.col("source")).count() == 0


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return path, tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_the_library(library):
    path, tokenizer = library
    codec = bpe.Codec(path)
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = ["", " ", "It's we'll I'D 12345 don't--stop…", "a<|endoftext|>B <|startoftext|><|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁ ½ é",
             "a\x1cb\x1d c\x85d e᠎f　g", "x" * 5000, "abcdefghij" * 700, "日本語のテキスト" * 50, "😀👩‍👩‍👧 ok", "that*** %%% $$$", "'s 't 'RE"]
    texts += ["".join(rng.choice(letters) for _ in range(60)) for _ in range(800)]
    texts += ["".join(rng.choice("abcdeth iénrs.,'sdl0\n") for _ in range(300)) for _ in range(200)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        got = bpe.np.frombuffer(codec.encode([text])[0], bpe.np.int32).tolist()
        assert got == want, repr(text)


def test_bpe_every_letter_alone(library):
    path, tokenizer = library
    codec = bpe.Codec(path)
    for c in [*range(0xD800), *range(0xE000, 0x20000, 7)]:
        text = f"a{chr(c)}b"
        got = bpe.np.frombuffer(codec.encode([text])[0], bpe.np.int32).tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_cuts_where_no_token_reaches(library):
    codec = bpe.Codec(library[0])
    for word in ("thstblewh", "qzxjkvw", "".join(codec.letters)):
        parts = codec.fragments(word)
        assert "".join(parts) == word
        whole = codec.merged_by_heap(list(word))
        assert [x for p in parts for x in codec.merged_by_heap(list(p))] == whole
        together = b"".join(codec._encode_fragments([(p, False) for p in parts]))
        assert bpe.np.frombuffer(together, bpe.np.int32).tolist() == [codec.vocab[x] for x in whole]


def test_bpe_forgets_words(library, monkeypatch):
    path, tokenizer = library
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    codec = bpe.Codec(path)
    texts = [f"alpha beta{i} gamma{i % 3}, Delta" for i in range(20)]
    for text in texts:
        assert bpe.np.frombuffer(codec.encode([text, text])[1], bpe.np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(codec.words) <= 5


def test_bpe_round_trip_on_odd_rows(spark, odd_docs, library):
    path, tokenizer = library
    docs = odd_docs(["Hello  wörld", "a<|endoftext|>b", "z" * 100_000])
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).count() == 0
