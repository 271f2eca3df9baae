from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_corpus import alnum_words, corpus, docs, no_docs, words  # noqa: F401
from test_decontaminate import brute as brute_leaks
from test_jaccard_join import brute as brute_classes
from test_language_metrics import brute_metrics
from test_native_operators import check_shards
from decoyscope.llm import mixing, sharding, tokenizer_quality

EXTRA = ("row", "doc", "topic", "tokens", "script", "items", "kept", "spans", "set", "n_words")
"""Columns of the caller that have the names of columns the operators make."""


@pytest.fixture(scope="module")
def table(corpus):
    """Rows of documents with clashing columns; each of them tells its document."""
    passage = " ".join(f"leaked{k}" for k in range(14))
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in corpus]
    rows += [(500, f"Before it all. {passage} and after it.", "en", "s1", 0), (501, passage, "en", "s2", 0), (502, None, None, None, None)]
    rows += [(600 + k, " ".join(f"plain{(7 * k + j) % 200}" for j in range(80)), "en", f"s{k % 3}", 0) for k in range(40)]
    return [(*row, *(f"{name}-{row[0]}" for name in EXTRA)) for row in rows], [(7, passage), (8, "too short to be found anywhere"), (9, None)]


DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{name}` string" for name in EXTRA)


@pytest.fixture(scope="module")
def folder(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table[0], DDL).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(table[1], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(spark, number, rows, folder):
    df = spark.createDataFrame(rows, DDL)
    out = corpus_pipeline.STAGES[number][1](spark, df, folder)
    if number < 4:
        assert out.schema.simpleString() == df.schema.simpleString()
    found = [tuple(r) for r in out.collect()]
    for row in found:  # the caller's columns are as they were
        assert row[5 : 5 + len(EXTRA)] == tuple(f"{name}-{row[0]}" for name in EXTRA)
    return out, found


def key(row):
    return tuple((x is None, x or "") for x in (str(row[0]) if row[0] is not None else None, row[1]))


def test_quality_keeps_what_the_operator_keeps(spark, table, folder):
    rows, _ = table
    _, found = stage(spark, 0, rows, folder)
    narrow = spark.createDataFrame([row[:3] for row in rows], "doc_id long, text string, lang string")
    want = [(r.doc_id, r.text) for r in tokenizer_quality.judged(narrow).where("kept").collect()]
    assert sorted(map(key, found)) == sorted(map(key, want)) and found
    for row in found:
        m = brute_metrics(row[1])
        assert m[0] >= 50 and 100 * m[4] <= 50 * m[0]


def test_one_document_of_each_class_stays(spark, table, folder):
    rows, _ = table
    _, found = stage(spark, 1, rows, folder)
    classes = brute_classes([row[:2] for row in rows])
    assert len(found) == len({(c, n == 0) for i, n, c in classes if c < 1 << 60}) + sum(1 for i, n, c in {c for c in classes if c[2] >= 1 << 60})
    assert {row[0] for row in found if row[0] is not None} == {c for _, _, c in classes if c < 1 << 60}


def test_leaked_words_go(spark, table, folder):
    rows, items = table
    _, found = stage(spark, 2, rows, folder)
    leaks = brute_leaks([row[1] for row in rows], items)
    want = {}
    for row, (n, hit, _) in zip(rows, leaks):
        if hit == 0 or hit < n:
            want.setdefault(row[0], []).append((row[1] if not hit else None, n - hit, row[4] if not hit else None))
    assert sorted(str(r[0]) for r in found) == sorted(str(i) for i, ws in want.items() for _ in ws)
    for row in found:
        options = want[row[0]]
        assert any((text is None or text == row[1]) and left == len(alnum_words(row[1])) for text, left, _ in options)
    assert 501 not in {row[0] for row in found} and next(r for r in found if r[0] == 500)[4] == len(next(r for r in found if r[0] == 500)[1])


def test_mixture_uses_real_topics(spark, table, folder):
    rows, _ = table
    _, found = stage(spark, 3, rows, folder)
    df = spark.createDataFrame([(*row[:4], row[7]) for row in rows], "doc_id long, text string, lang string, source string, real string")
    want = [(r.doc_id, r.text) for r in mixing.mix(df, topic=F.col("real")).where("kept").collect()]
    assert sorted(map(key, found)) == sorted(map(key, want)) and found


def test_shards(spark, table, folder):
    rows, _ = table
    out, found = stage(spark, 4, rows, folder)
    check_shards(out.withColumn("_bits", sharding.content_bits(F.col("doc_id"), F.col("text"))).collect(), sharding.SHARD_BYTES)
    assert len(found) == len(rows)


def test_run_is_the_stages_one_after_another(spark, table, folder):
    rows = {}
    for row in table[0]:
        rows.setdefault(row[0], []).append(row)
    found = corpus_pipeline.run(spark, folder).collect()
    assert found
    for r in found:
        first = rows[r.doc_id][0]
        assert tuple(r)[5 : 5 + len(EXTRA)] == first[5:] and (r.text in [x[1] for x in rows[r.doc_id]] or r.doc_id == 500)
        assert 501 != r.doc_id and len(words(r.text)) >= 20
    assert len({r.doc_id for r in found}) == len(found)


def test_empty_documents(spark, folder):
    empty = spark.createDataFrame([], DDL)
    for _, stage_of in corpus_pipeline.STAGES:
        assert stage_of(spark, empty, folder).count() == 0
