from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from llm_corpus import corpus, docs, no_docs  # noqa: F401
from decoyscope.llm import toxicity


def naive_segments(scores, low=0, high=None):
    """The definition: the best segment (of equals the leftmost, then shortest), then the same left and right of it."""
    high = len(scores) if high is None else high
    best = (0, None)
    for a in range(low, high):
        total = 0
        for b in range(a, high):
            total += scores[b]
            if total > best[0]:
                best = (total, (a, b + 1))
    if best[1] is None:
        return []
    a, b = best[1]
    return naive_segments(scores, low, a) + [(a, b, best[0])] + naive_segments(scores, b, high)


def test_segments_equal_the_definition():
    chance = random.Random(4)
    for _ in range(300):
        scores = [chance.uniform(-3, 2) for _ in range(chance.randint(0, 25))]
        found, want = toxicity.segments(np.array(scores)), naive_segments(scores)
        assert [x[:2] for x in found] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in found], [x[2] for x in want])


def test_segments_of_a_long_text_take_one_pass():
    scores = np.tile([-1.0, 0.5, -0.25, 0.9], 200_000)
    assert len(toxicity.segments(scores)) > 0


def _labelled(spark, n=700):
    chance = random.Random(9)
    plain = ["".join(chance.choice("abdeghilmnorst") for _ in range(chance.randint(2, 9))) for _ in range(400)]
    insults = ["scumbag", "vileling", "trashface", "moronic"]
    texts, labels = [], []
    for k in range(n):
        body = [chance.choice(plain) for _ in range(chance.randint(20, 120))]
        toxic = int(chance.random() < 0.25)
        if toxic:
            at = chance.randint(0, len(body))
            body[at:at] = [chance.choice(insults) + chance.choice(("", "s", "ish")) for _ in range(3)]
        texts.append((k, " ".join(body), "en", "s"))
        labels.append((k, toxic))
    return texts, labels


def test_held_out_documents_are_told_apart(spark):
    texts, labels = _labelled(spark)
    rows = [*texts, (None, "scumbag moronic trashface vileling", "en", "s"), (9001, None, "en", "s"), (9002, "", "en", "s"), texts[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"score": F.lit("x"), "toxic": F.lit(1)}).repartition(4)
    marked = spark.createDataFrame([*labels, (3, None), (None, 1), (5, labels[5][1]), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, marked)
    found = toxicity.score(df, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = dict(labels)
    held = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held)
    assert len(held) > 80 and right / len(held) > 0.95
    nothing = {r.score for r in found if r.doc_id in (9001, 9002)}
    assert len(nothing) == 1 and nothing.pop() < 0.5
    for r in held:
        if truth[r.doc_id] == 1 and r.segments:
            assert any(word in r.text[s.start : s.end] for s in r.segments for word in ("scumbag", "vileling", "trashface", "moronic"))


def test_labels_of_one_kind_or_none(spark, docs, no_docs):
    one = spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {toxicity.score(docs, toxicity.train(docs, one)).first().score}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, none)).collect())
    assert toxicity.score(no_docs, toxicity.train(no_docs, none)).count() == 0
