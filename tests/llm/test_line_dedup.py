from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from llm_corpus import corpus, docs, no_docs  # noqa: F401
from decoyscope.llm import line_dedup

LAST = line_dedup.LAST


def brute(rows, least=10):
    """Sorted (doc_id, n_lines, n_dropped, kept text)."""
    fold = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    owner = defaultdict(lambda: LAST + 1)
    for i, text in rows:
        for line in (text or "").split("\n"):
            owner[fold(line)] = min(owner[fold(line)], LAST if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(fold(x)) < least or owner[fold(x)] == (LAST if i is None else i)]
        out.append((LAST if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(df):
    rows = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()
    return sorted((LAST if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows)


def test_equals_brute_force(docs, corpus):
    assert run(docs.withColumns({"n_lines": F.lit(9), "_keep2": F.lit(1)})) == brute([(i, t) for i, t, _, _ in corpus])


def test_hot_line_ties_and_edges(spark, no_docs):
    hot = " Everyone Has This Line\t"
    rows = [(k, f"own line number {k}\n{hot}\n{hot.lower()}\nshort\n") for k in range(3000)]
    rows += [(5, "own line number 5\nshort"), (None, hot), (None, "own line number 7"), (7, "x" * 200_000 + "\n" + "x" * 200_000), (9, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert run(df) == brute(rows)
    assert run(no_docs) == []


def test_bitmaps_hold_no_text(docs):
    assert line_dedup.keep_bitmaps(docs).columns == ["doc", "row", "n_lines", "n_dropped", "keep"]
