from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_corpus import alnum_words, corpus, docs, no_docs, words  # noqa: F401
from decoyscope.llm import backoff, tokenizer_quality


def brute_metrics(text):
    text = text or ""
    w = words(text)
    raw = [x for x in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    grams = Counter(tuple(raw[k : k + 3]) for k in range(len(raw) - 2))
    covered = {k + j for k in range(len(raw) - 2) if grams[tuple(raw[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, raw)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_base_metrics_equal_brute_force(docs, corpus):
    found = tokenizer_quality.judged(docs.withColumns({"n_words": F.lit("clash"), "kept": F.lit(1), "extra": F.lit(2)}))
    rows = found.collect()
    key = lambda i, t: (-1 if i is None else i, t or "")
    got = sorted((*key(r.doc_id, r.text), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for i, t, _, _ in corpus:
        m = brute_metrics(t)
        want.append((*key(i, t), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want)
    assert all(r.kept is not None and not (r.base_failed and r.kept) and r.extra == 2 for r in rows)
    assert all(r.n_tokens == 0 for r in rows if not r.text)


def test_token_metrics(spark):
    encoder, partial = tokenizer_quality._encoder(tokenizer_quality.VOCABULARY)
    texts = ["The quick brown fox. " * 8, "日本語のテキスト", "a b " * 40_000, "x" * 150_000, " " * 150_000]
    found = tokenizer_quality.metrics(__import__("pyarrow").array(texts), tokenizer_quality.VOCABULARY)
    names = [name for name, _ in tokenizer_quality._FIELDS]
    n, fallback, entropy = (found[names.index(x)].to_pylist() for x in ("n_tokens", "n_fallback", "token_entropy"))
    for k in (0, 1, 2):
        ids = encoder.encode_ordinary(texts[k])
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert n[k] == len(ids) and fallback[k] == int(partial[ids].sum())
        assert entropy[k] == pytest.approx(-(share * np.log2(share)).sum())
    assert found[names.index("script")].to_pylist()[:2] == ["latin", "cjk"]


def test_bands_reject_odd_texts_only(spark):
    chance = np.random.default_rng(2)
    vocabulary = ["water", "river", "mountain", "people", "through", "morning", "quiet", "station", "garden", "between"]
    plain = [(k, " ".join(chance.choice(vocabulary, 120)) + f" {k}", "en") for k in range(300)]
    odd = [(1000, " ".join("qzx" + "".join(chance.choice(list("qxzjkv0987"), 8)) for _ in range(120)), "en"), (1001, "### $$$ %%% ||| " * 60 + " ".join(chance.choice(vocabulary, 60)), "en")]
    kept = {r.doc_id for r in tokenizer_quality.judged(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")).where("kept").collect()}
    repeated = {k for k, text, _ in plain if 100 * brute_metrics(text)[4] > 50 * brute_metrics(text)[0]}
    assert kept == {k for k, _, _ in plain} - repeated


def test_bands_reject_junk_without_the_symbol_rule(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    metered = tokenizer_quality.judged(docs, keep_text=False).where("not base_failed")
    limits = tokenizer_quality.bands(metered)
    rows = metered.withColumn("inside", tokenizer_quality.in_bands(limits)).select("quality", "inside").collect()
    good, junk = ([r.inside for r in rows if r.quality == q] for q in (1, 0))
    assert sum(junk) < 0.3 * len(junk) and sum(good) > 0.98 * len(good)


def test_no_rows(no_docs):
    assert tokenizer_quality.judged(no_docs).count() == 0
    assert backoff.score(no_docs).count() == 0


@pytest.mark.parametrize("order, least", [(3, 2), (1, 2), (4, 1)])
def test_backoff_equals_brute_force(docs, corpus, order, least):
    counts = Counter()
    texts = [alnum_words(t) for _, t, _, _ in corpus]
    for w in texts:
        for n in range(1, order + 1):
            counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = sum(map(len, texts))
    want = []
    for (i, _, _, _), w in zip(corpus, texts):
        score = 0.0
        for k in range(len(w)):
            n, factor = min(order, k + 1), 1.0
            while n > 1 and counts[tuple(w[k - n + 1 : k + 1])] < least:
                n, factor = n - 1, factor * backoff.ALPHA
            gram = tuple(w[k - n + 1 : k + 1])
            score += np.log(factor * counts[gram] / (counts[gram[:-1]] if n > 1 else total))
        want.append((-1 if i is None else i, len(w), round(score, 4)))
    found = backoff.score(docs.withColumn("block", F.lit("x")), order=order, least=least).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.log_score, 4)) for r in found) == sorted(want)
    assert all((r.perplexity is None) == (r.n_words == 0) for r in found)
