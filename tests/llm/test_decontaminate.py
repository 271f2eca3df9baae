from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_corpus import alnum_words, corpus, docs, no_docs  # noqa: F401
from decoyscope.llm import decontaminate
from decoyscope.llm.decontaminate import FMIndex


def brute(texts, items, width=10):
    owners = {}
    for item, text in items:
        w = alnum_words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = []
    for text in texts:
        w = alnum_words(text)
        hit, who = set(), set()
        for size in {len(phrase) for phrase in owners}:
            for k in range(len(w) - size + 1):
                if (found := owners.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    who |= found - {None}
        out.append((len(w), len(hit), sorted(who)))
    return out


def test_index_finds_all_places_of_all_phrases():
    chance = random.Random(1)
    sequence = [chance.choice((1, 1, 2, 3, 0)) for _ in range(400)] + [0]
    index = FMIndex(np.array(sequence), 4)
    phrases = [[1], [1, 1], [2, 1, 3], [3, 3, 3, 3], [1, 2, 1, 1]]
    matrix = np.array([[0] * (4 - len(p)) + p for p in phrases])
    low, high = index.ranges(matrix, np.array([len(p) for p in phrases]))
    for k, phrase in enumerate(phrases):
        places = sorted(index.locate(np.arange(low[k], high[k])).tolist())
        assert places == [i for i in range(len(sequence)) if sequence[i : i + len(phrase)] == phrase]


@pytest.fixture(scope="module")
def items(corpus):
    long = [text for _, text, _, _ in corpus if text and len(alnum_words(text)) > 30][:5]
    return [(str(k), " ".join(alnum_words(text)[3:25])) for k, text in enumerate(long)] + [
        ("short", "the OF"), ("missing", None), ("empty", ""), ("dots", "..."), (None, "one"), ("twice", "w1 w2 w3"), ("twice", "w1 w2 w3"),
        ("long", " ".join(alnum_words(corpus[87][1])[500:560])),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_equal_brute_force_in_one_block_or_many(spark, docs, corpus, items, block_bytes):
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    clashing = docs.withColumns({"items": F.lit("x"), "n_words": F.lit(-1), "extra": F.lit(7)})
    rows = decontaminate.find(clashing, benchmark, block_bytes=block_bytes).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.n_words, r.n_hit, r["items"], r.extra) for r in rows)
    texts = [text for _, text, _, _ in corpus]
    want = sorted((-1 if i is None else i, t or "", *b, 7) for (i, t, _, _), b in zip(corpus, brute(texts, items)))
    assert got == want
    for r in rows:  # spans hold exactly the hit words
        inside = sum(len(alnum_words(r.text[s.start : s.end])) for s in r.spans)
        assert inside == r.n_hit


def test_cut_takes_spans_out(spark, items, docs):
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id string, text string"))
    for r in found.withColumn("cut", decontaminate.cut(F.col("text"), F.col("spans"))).collect():
        if r.text is None:
            assert r["cut"] is None
            continue
        at, pieces = 0, []
        for s in r.spans:
            pieces.append(r.text[at : s.start])
            at = s.end
        assert r["cut"] == "\n".join([*pieces, r.text[at:]])


def test_empty_tables(spark, docs, no_docs, items):
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate.find(no_docs, benchmark).count() == 0
    assert decontaminate.find(docs, benchmark.where("false")).where("n_hit > 0").count() == 0
