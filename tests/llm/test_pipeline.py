"""The corpus pipeline and the queries that SQL cannot express, against brute force over small tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import queries, toxicity
from ledgerline.llm.common import table
from test_pairs_and_models import brute_fingerprint
from test_text_operators import brute_hits

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int, line int, score string, h1 int, place string"


def written(spark, folder, documents, labels, benchmark):
    spark.createDataFrame(documents, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    fine = [f"word{i}" for i in range(400)]

    def body(n):
        return " ".join(rng.choice(fine) for _ in range(n))

    items = [(f"i{i}", body(n)) for i, n in enumerate((14, 30, 10, 6))] + [("none", None), ("dots", "..."), ("i0", body(11))]
    texts, labels = [], []
    for i in range(420):
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        words = body(rng.randint(60, 160)).split(" ")
        if toxic:
            for word in ("vile", "rotten"):
                words[rng.randrange(len(words))] = word
        at = rng.randrange(len(words))
        lines = [" ".join(words[:at]), " ".join(words[at:]) + ("." if good else " $$$ ### !!!" * 6)]
        if i % 5 == 0:
            lines.insert(rng.randrange(3), "Subscribe to our newsletter today")
        if i % 40 == 1:
            lines.append("A line that stands on few sites")
        texts.append("\n".join(lines))
        if i < 300:
            labels.append((i, int(good), int(toxic)))
    for i in range(12):  # exact copies, near copies, benchmark passages inside other text
        texts.append(texts[i * 7])
        long = body(500)
        texts += [long, long + " tail"]
        texts.append(f"{body(20)}, {items[i % 4][1].upper()}! {body(20)}")
    texts += [None, "", " \n", "one", "One", "word1 " * 20_000]
    rows = [(i, t, "en", None if i % 50 == 49 else f"s{i % 14}", len(t or ""), 1, "x", 2, "p") for i, t in enumerate(texts)]
    rows += [(None, body(90), None, None, None, None, None, None, None), rows[3]]
    odd = [(None, 1, 1), (1, None, None), (5000, 0, 1)]
    return written(spark, tmp_path_factory.mktemp("tables"), rows, labels + odd, items)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary_path())


def without_wide_lines(rows, sites):
    """Rows (doc_id, text, source) without the lines on many sources, but for their first occurrence."""
    spread, first = {}, {}
    for doc, text, source in rows:
        for place, line in enumerate([] if text is None else text.split("\n")):
            if line.strip(" "):
                spread.setdefault(line, set()).update([] if source is None else [source])
                key = (doc is None, doc or 0, place)
                first[line] = min(first.get(line, key), key)
    out = []
    for doc, text, _ in rows:
        kept = None if text is None else "\n".join(
            x for p, x in enumerate(text.split("\n"))
            if not x.strip(" ") or len(spread[x]) < sites or first[x] == (doc is None, doc or 0, p))
        out.append((doc, kept))
    return out


def groups(prints, distance):
    """For each index the smallest index that links reach."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return [top(i) for i in range(len(prints))]


def test_pipeline_matches_brute_force(spark, folder, library):
    documents = table(spark, folder, "documents")
    scored = toxicity.toxicity(documents, table(spark, folder, "labels"))
    clean = [(r.doc_id, r.text, r.source) for r in scored.where("predicted = 0").collect()]
    marked = [r for r in scored.collect() if r.text and "vile" in r.text]
    assert len(marked) > 100 and sum(r.predicted for r in marked) > 0.95 * len(marked)
    assert len(clean) > 0.97 * (documents.count() - len(marked))

    cut = without_wide_lines(clean, 10)
    assert cut != [(d, t) for d, t, _ in clean]
    label = groups([brute_fingerprint(t, 4) for _, t in cut], 4)
    best = {}
    for (doc, text), group in zip(cut, label, strict=True):
        rank = (doc is None, doc or 0)
        if group not in best or rank < best[group][0]:
            best[group] = rank, doc, text
    assert len(best) < len(cut) - 20
    items = [tuple(r) for r in table(spark, folder, "benchmark").collect()]
    kept = {doc: text for _, doc, text in best.values() if not brute_hits(text, items, 10)[1]}
    assert len(kept) < len(best)
    want = {doc: library.encode(text or "", add_special_tokens=False).ids for doc, text in kept.items()}

    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) == len(want) and {r.doc_id: list(r.ids) for r in rows} == want
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_encoding_stage_decodes_and_encodes_again(spark, folder, library):
    texts = ["word1 Word2, 3.14!", "a b c", "", None, "e\u0301t\u00e9 \u4f60\u597d", "un" * 60]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in corpus_pipeline.encode(spark, docs, folder).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (list(r.ids), r.decoded_sha256) == (ids, sha(text))
        assert r.same_ids == (library.encode(text, add_special_tokens=False).ids == ids)


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = table(spark, folder, "documents").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
    cut = corpus_pipeline.drop_boilerplate(spark, table(spark, folder, "documents"), folder)
    assert cut.where("n_chars <> char_length(text)").count() == 0


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    empty = written(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    rows = [(1, "a b c", "en", "s", 5, 1, "x", 1, "p"), (2, None, None, None, None, None, None, None, None)]
    bare = written(spark, tmp_path / "bare", rows, [], [])
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, bare).collect()) == [(1, 3), (2, 0)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_query(spark, folder, library):
    want = []
    for r in table(spark, folder, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = queries.bpe_round_trip(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_simhash_query(spark, folder):
    rows = table(spark, folder, "documents").collect()
    prints = [brute_fingerprint(r.text, 4) for r in rows]
    label, least = groups(prints, 4), {}
    for r, group in zip(rows, label, strict=True):
        if r.doc_id is not None:
            least[group] = min(least.get(group, r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, label, strict=True)]
    got = queries.simhash_components(spark, folder).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize(("query", "label", "parts", "out"), [
    (queries.toxicity_scores, "toxic", 5, 0), (queries.quality_scores, "quality", 3, 1)])
def test_held_out_labels_teach_nothing(spark, folder, tmp_path, query, label, parts, out):
    def held(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == out

    got = query(spark, folder).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(bool(r.held_out) == held(r.doc_id) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    labels = table(spark, folder, "labels")
    truth = {r.doc_id: r[label] for r in labels.collect()}
    tested = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(tested) > 30 and sum(r.predicted == truth[r.doc_id] for r in tested) > 0.9 * len(tested)
    flipped = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == out, 1 - F.col(label)).otherwise(F.col(label))
    for name in ("documents", "benchmark"):
        table(spark, folder, name).write.parquet(f"{tmp_path}/{name}.parquet")
    labels.withColumn(label, flipped).write.parquet(f"{tmp_path}/labels.parquet")
    again = query(spark, str(tmp_path)).select("doc_id", "score").collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in got}


def test_license_query_keeps_documents_without_an_id(spark, tmp_path):
    rows = [(1, "All rights reserved.", "en", "s", 1, 1, "x", 1, "p"), (2, None, None, None, None, None, None, None, None)]
    folder = written(spark, tmp_path / "licenses", rows + [(None, "All rights reserved.", *rows[0][2:])], [], [])
    got = {(r.doc_id, r.n_matches, r.licenses) for r in queries.license_scan(spark, folder).collect()}
    assert got == {(1, 1, "proprietary"), (2, 0, ""), (None, 1, "proprietary")}
