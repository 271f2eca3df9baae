from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from llm_corpus import corpus, docs, no_docs, words  # noqa: F401
from decoyscope.llm import simhash, textkit
from decoyscope.llm.common import stored
from decoyscope.llm.components import components
from decoyscope.settings import configure

LAST = simhash.LAST


def mark(text):
    w = words(text)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(marks):
    """Root of each mark by comparing all pairs."""
    marks, up = sorted(set(marks)), {m: m for m in marks}

    def root(m):
        while up[m] != m:
            m = up[m]
        return m

    for k, a in enumerate(marks):
        for b in marks[:k]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    return {m: root(m) for m in marks}


def brute(rows):
    marks = [mark(text) for _, text in rows]
    root, least = roots(marks), {}
    for (i, _), m in zip(rows, marks):
        least[root[m]] = min(least.get(root[m], LAST), LAST if i is None else i)
    return sorted((LAST if i is None else i, f"{m:016x}", least[root[m]]) for (i, _), m in zip(rows, marks))


def run(df):
    big = lambda value: LAST if value is None else value
    return sorted((big(r.doc_id), r.fingerprint, big(r.component_id)) for r in simhash.classes(df).collect())


def test_classes_equal_brute_force(docs, corpus):
    clashing = docs.withColumns({"mark": F.lit("clash"), "root": F.lit(1), "doc": F.lit(2), "key": F.lit(3)})
    assert run(clashing) == brute([(i, t) for i, t, _, _ in corpus])


def test_empty_table(no_docs):
    assert run(no_docs) == []


def test_only_empty_texts(spark):
    rows = [(4, None), (2, ""), (None, " \n"), (2, "")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((LAST if i is None else i, "0" * 16, 2) for i, _ in rows)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"Word{k % 89}" for k in range(4000)) + "  \n"
    whole = simhash.fingerprint(text.encode())
    assert whole == mark(text)
    for size in (1, 7, 64, 5000):
        monkeypatch.setattr(textkit, "CHUNK_BYTES", size)
        assert simhash.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("limit", [1, 1024])
def test_links_of_dense_and_lone_fingerprints(spark, limit):
    """Chains of three flipped bits, a dense cloud round a hub, marks that share a half only, and copies of a mark."""
    chance = random.Random(6)
    flip = lambda m, k: m ^ sum(1 << b for b in chance.sample(range(64), k))
    marks = [chance.getrandbits(64) for _ in range(50)]
    chain = [marks[0]]
    for _ in range(30):
        chain.append(flip(chain[-1], 3))
    cloud = [flip(marks[1], chance.randint(1, 5)) for _ in range(60)]
    half = [(marks[2] & 0xFFFFFFFF) | chance.getrandbits(32) << 32 for _ in range(60)]
    low = [marks[3] & ~0xFFF | chance.getrandbits(12) for _ in range(60)]
    apart = [flip(marks[4], 4), flip(marks[5], 3), flip(marks[6], 2), 0, (1 << 64) - 1, 1 << 63, 7]
    marks += chain + cloud + half + low + apart
    chance.shuffle(marks)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = [(signed(m), 1 + k % 3) for k, m in enumerate(sorted(set(marks)))]
    found = components(simhash.links(spark.createDataFrame(rows, "mark long, n long"), limit)).collect()
    got, want = {}, {}
    named = {r.node: r.root for r in found}
    for m, root in roots(marks).items():
        want.setdefault(root, set()).add(m)
        got.setdefault(named.get(signed(m), signed(m)), set()).add(m)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_variants_and_documents_are_never_broadcast(spark, monkeypatch):
    """The size estimate leaves out that a fingerprint is repeated 64 times: a broadcast of them took all of the driver's memory."""
    plans = {}

    def planned(df, name):
        df.collect()  # the plan that ran, not the one it began with
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", planned)
    rows = [(k, " ".join(f"w{k // 3 * 100 + j}" for j in range(40 + k % 3 // 2))) for k in range(30)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect()) == brute(rows)
        for plan in (*plans["simhash-keys"], found._jdf.queryExecution().executedPlan().toString()):
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        configure(spark)
