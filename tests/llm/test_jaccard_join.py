from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from llm_corpus import corpus, docs, no_docs, words  # noqa: F401
from decoyscope.llm import jaccard_join
from decoyscope.llm.components import components

LAST = jaccard_join.LAST


def brute(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    ids = [LAST if i is None else i for i, _ in rows]
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), LAST), i)
    return sorted((ids[k], len(sets[k]), least[root(k)]) for k in range(len(rows)))


def run(df):
    big = lambda value: LAST if value is None else value
    return sorted((big(r.doc_id), r.n_shingles, big(r.component_id)) for r in jaccard_join.classes(df).collect())


def test_classes_equal_brute_force(docs, corpus):
    assert run(docs.withColumns({"row": F.lit("clash"), "set": F.lit(1), "doc": F.lit(2)})) == brute([(i, t) for i, t, _, _ in corpus])


def test_empty_table(no_docs):
    assert run(no_docs) == []


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_hard_groups(spark, monkeypatch, broadcast):
    """A chain of links, a group with a hub only, a large group of copies, and a common passage in unlike texts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        chance = random.Random(3)
        new = lambda n: [f"{chance.randrange(10**6)}" for _ in range(n)]
        texts = []
        window = new(400)
        texts += [" ".join(window[6 * k : 6 * k + 60]) for k in range(40)]
        hub = new(100)
        for _ in range(25):
            edited = list(hub)
            for k in chance.sample(range(100), 2):
                edited[k] = new(1)[0]
            texts.append(" ".join(edited))
        texts += [" ".join(hub)] * 30
        passage = new(40)
        texts += [" ".join(new(10) + passage + new(chance.randint(5, 12))) for _ in range(60)]
        rows = list(enumerate(texts))
        chance.shuffle(rows)
        assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_runs_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    chance = random.Random(8)
    new = lambda n: [f"{chance.randrange(10**6)}" for _ in range(n)]
    passage = new(60)
    rows = [(k, " ".join(new(chance.randint(2, 16)) + passage + new(chance.randint(2, 16)))) for k in range(50)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_row_of_each_class_stays(spark, docs, corpus):
    kept = jaccard_join.representatives(docs).collect()
    classes = {c for _, _, c in brute([(i, t) for i, t, _, _ in corpus]) if c != LAST}
    assert {r.doc_id for r in kept if r.doc_id is not None} == classes
    assert len([r for r in kept if r.doc_id == 0]) == 1
    assert jaccard_join.representatives(docs).columns == docs.columns


def test_components_of_a_long_chain_and_a_star(spark):
    ids = list(range(1000, 1300))
    random.Random(2).shuffle(ids)
    links = [(ids[k], ids[k + 1]) for k in range(len(ids) - 1)] + [(5, k) for k in range(6, 300)] + [(9000, 9000), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(k, 1000) for k in ids} | {(k, 5) for k in range(5, 300)}


@pytest.mark.parametrize("tile,least", [(4, 1), (16, 32)])
def test_long_runs_of_many_sizes(spark, monkeypatch, tile, least):
    """A passage in texts of all sizes: links between neighbouring sizes only, few smallest keys brought along."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "LEAST", least)
    chance = random.Random(12)
    new = lambda n: [f"{chance.randrange(10**6)}" for _ in range(n)]
    passage = new(200)
    texts = []
    for _ in range(90):
        size = chance.choice([5, 12, 30, 60, 110, 200])
        texts.append(" ".join(passage[:size] + new(chance.randint(0, size // 3 + 1))))
    rows = list(enumerate(texts))
    chance.shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
