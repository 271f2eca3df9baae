from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm_corpus import corpus, docs, no_docs  # noqa: F401
from decoyscope.llm import spelling, textkit


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(found[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted((w, forms[w] or "", root(w), n, len(found[w]), words.get(forms[w], 0)) for w, n in words.items())


def run(df, **options):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df, **options).collect())


def variant_rows(seed=4):
    """Words in families: variants of variants, edits at every place, runs of one letter, long words, ties."""
    chance = random.Random(seed)
    letters = "abcdeéÿÀz"
    edit = lambda w, k: chance.choice([w[:k] + w[k + 1 :], w[:k] + chance.choice(letters) + w[k:], w[:k] + chance.choice(letters) + w[k + 1 :]])
    words = ["".join(chance.choice(letters) for _ in range(chance.randint(6, 12))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "x" * 300 + "y"]
    rows = []
    for word in words:
        family = [word] + [edit(word, chance.randrange(len(word))) for _ in range(12)]
        family += [edit(chance.choice(family), 0) for _ in range(4)] + [edit(word, len(word) - 1), word + "d", "d" + word]
        for k, one in enumerate(family):
            rows.append(" ".join([one] * chance.choice([3, 5, 6, 30, 160] if k else [160, 800])))
    return list(enumerate(rows))


@pytest.mark.parametrize("shard", [4, 1 << 15])
def test_variants_equal_brute_force(spark, shard):
    rows = variant_rows()
    rows += [rows[0], (None, rows[1][1]), (3, None), (4, ""), (5, "short Éé Word×word÷ WORDword wordWORD. " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "key": F.lit(2)})
    found = run(df, shard=shard)
    assert found == brute(rows)
    assert any(root != word and root != form for word, form, root, *_ in found if form)  # a chain of forms


def test_corpus_equals_brute_force(docs, corpus, monkeypatch):
    monkeypatch.setattr(textkit, "CHUNK_BYTES", 50)
    assert run(docs) == brute([(i, t) for i, t, _, _ in corpus])


def test_empty_table(no_docs):
    assert run(no_docs) == []


def test_index_finds_every_word_one_edit_away():
    chance = random.Random(9)
    words = sorted({"".join(chance.choice("abc") for _ in range(chance.randint(6, 9))) for _ in range(900)})
    index = spelling.Index(words)
    for length in range(6, 10):
        asked = [w for w in words if len(w) == length]
        import numpy as np

        query, number = index.near(np.stack([spelling.encoded(w) for w in asked]))
        found = {(asked[q], words[k]) for q, k in zip(query.tolist(), number.tolist())}
        assert found == {(a, b) for a in asked for b in words if near(a, b)}
