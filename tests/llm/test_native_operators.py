from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_corpus import corpus, docs, no_docs  # noqa: F401
from decoyscope.llm import mixing, secret_scan, sharding

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in pattern.finditer(text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                found.append((m.start(), order, kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


@pytest.fixture(scope="module")
def secrets(spark, corpus):
    live = "Zx9" + hashlib.sha256(b"live").hexdigest()[:20].upper() + "q"
    copied = "Ab1" + hashlib.sha256(b"copied").hexdigest()[:20].upper() + "q"
    rows = [(i, t, s) for i, t, _, s in corpus]
    rows += [(1000 + k, f"éé🙂 {copied} and API_KEY = '{k:06d}abc' x", f"o{k}") for k in range(4)]
    rows += [
        (2000, f"token: {live} secret=\"token: abcdefgh\" passwd='abc' password==short", "o1"), (2001, "AKIA" + "A1" * 20 + " AKIAB AKIA" + "Z" * 16, "o2"),
        (2002, "a" * 24 + "g" + "0" * 23 + " " + "f" * 40, None), (2003, "secret=" + "x" * 100_000 + " " + "token=abcdef " * 2000, "o3"),
        (2003, "token=abcdef", "o3"), (2003, "token=abcdef", "o3"), (None, "token=abcdef", None), (2004, "ApiKey:\n secret = \t 123456", "o1"),
    ]
    return rows


def test_base_spans_equal_the_patterns(spark, secrets):
    df = spark.createDataFrame(secrets, "doc_id long, text string, source string").withColumns({"start": F.lit(1), "value": F.lit("v")}).repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base) for r in secret_scan.scan(df).collect())
    want = []
    for i, text, _ in secrets:
        base = base_spans(text)
        kinds = Counter(span.split(":")[0] for span in base.split(",") if span)
        want.append((-1 if i is None else i, kinds["assign"], kinds["access"], kinds["hex"], base))
    assert got == sorted(want)


def test_copied_values_are_not_owned(spark, secrets):
    df = spark.createDataFrame(secrets, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in secret_scan.scan(df).collect() if r.doc_id is not None}
    assert all("owned" not in rows[1000 + k].spans for k in range(4))
    assert "owned" in rows[2000].spans and rows[2000].n_live == 3
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in rows.values())


def test_owners_are_judged_before_repositories(spark):
    keys = {name: "Kq7" + hashlib.sha256(name.encode()).hexdigest()[:20].upper() + "w" for name in ("one", "two", "few", "none")}
    rows = [(k, f"key {keys['one']}", "o1") for k in range(40)]  # one owner, many documents
    rows += [(100 + k, f"key {keys['two']}", f"o{k % 2}") for k in range(6)] + [(200 + k, f"key {keys['few']}", f"o{k % 2}") for k in range(5)]
    rows += [(300 + k, f"key {keys['none']}", None) for k in range(9)]  # a missing owner is one owner
    found = {r.doc_id: "owned" in r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {i: not 100 <= i < 200 for i, _, _ in rows}


def test_secret_scan_of_no_rows(no_docs):
    assert secret_scan.scan(no_docs).count() == 0


def check_shards(rows, limit):
    held, members = defaultdict(int), defaultdict(set)
    for r in rows:
        held[r.shard] += r.bytes
        members[r.shard].add(r._bits)
    assert all(r.shard_bytes == held[r.shard] and r.depth == len(r.shard) and r.oversized == (held[r.shard] > limit) for r in rows)
    assert all(held[s] <= limit or len(members[s]) == 1 for s in held)
    for shard in held:  # only prefixes that were too large, and not one row, were split
        assert not any(shard[:k] in held for k in range(len(shard)))
        if shard:
            above = [s for s in held if s.startswith(shard[:-1])]
            assert sum(held[s] for s in above) > limit


@pytest.mark.parametrize("limit", [1 << 30, 20_000, 700, 1])
def test_shards_split_only_where_too_large(docs, limit):
    clashing = docs.withColumns({"shard": F.lit("x"), "bytes": F.lit(3), "cell": F.lit(1)})
    found = sharding.shard(clashing, limit)
    rows = found.withColumn("_bits", sharding.content_bits(F.col("doc_id"), F.col("text"))).collect()
    assert len(rows) == docs.count() and {"cell", "lang"} <= set(found.columns)
    assert all(r.bytes == len((r.text or "").encode()) for r in rows)
    check_shards(rows, limit)


def test_shards_of_no_rows_and_of_equal_rows(spark, no_docs):
    assert sharding.shard(no_docs).count() == 0
    rows = sharding.shard(spark.createDataFrame([(1, "abc")] * 5, "doc_id long, text string"), 10).collect()
    assert {(r.shard_bytes, r.oversized) for r in rows} == {(15, True)}


def rake(cells, targets, sweeps):
    weight = {c: float(t) for c, t in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            held = Counter()
            for c, w in weight.items():
                held[c[d]] += w
            weight = {c: w * targets[d][c[d]] / held[c[d]] for c, w in weight.items()}
    top = max(w / cells[c] for c, w in weight.items())
    return {c: w / cells[c] / top for c, w in weight.items()}


def test_mix_equals_brute_force_raking(docs, corpus):
    given = {"lang": {"en": 0.5, "de": 0.3, "": 0.2}}
    rows = mixing.mix(docs.withColumns({"tokens": F.lit("x"), "kept": F.lit(0)}), targets=given).collect()
    assert len(rows) == len(corpus)
    name = lambda r: (r.source or "", r.lang or "", r.topic)
    assert all(r.tokens == max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows)
    cells = Counter()
    for r in rows:
        cells[name(r)] += r.tokens
    targets = []
    for d in range(3):
        held = Counter()
        for c, t in cells.items():
            held[c[d]] += t
        shares = given["lang"] if d == 1 else {v: t**mixing.TEMPER for v, t in held.items()}
        targets.append({v: shares[v] / sum(shares.values()) for v in held})
    want = rake(cells, targets, mixing.SWEEPS)
    for r in rows:
        assert r.probability == pytest.approx(want[name(r)], rel=1e-9)
        bits = int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        assert r.kept == (bits / 2**60 < r.probability)


def test_mix_meets_targets(spark):
    rows = [(k, "a b c d e", ("en", "de")[k % 5 == 0], ("big", "small")[k % 3 == 0]) for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = mixing.mix(df, targets={"lang": {"en": 0.5, "de": 0.5}, "source": {"big": 0.5, "small": 0.5}}).where("kept").cache()
    n = kept.count()
    for column in ("lang", "source"):
        assert all(abs(r["count"] / n - 0.5) < 0.02 for r in kept.groupBy(column).count().collect())


def test_raking_goes_on_until_margins_meet_targets(spark):
    rows = [(f"s{i}", f"l{j}", "t", 700 if i == j else 100) for i in range(4) for j in range(4)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    share = {"source": [0.4, 0.3, 0.2, 0.1], "lang": [0.2, 0.2, 0.3, 0.3]}
    targets = {d: spark.createDataFrame([(f"{d[0]}{k}", x) for k, x in enumerate(v)], f"{d} string, target double") for d, v in share.items()}
    targets["topic"] = spark.createDataFrame([("t", 1.0)], "topic string, target double")
    fitted = mixing.rake(cells, targets)
    for d, v in share.items():
        held = {r[d]: r["w"] for r in fitted.groupBy(d).agg(F.sum("weight").alias("w")).collect()}
        assert all(held[f"{d[0]}{k}"] == pytest.approx(x, rel=1e-7) for k, x in enumerate(v))


def test_targets_that_cannot_be_met_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, tokens long")
    given = {"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.5, "y": 0.5}}
    with pytest.warns(RuntimeWarning, match="targets are not met"):
        mixing.probabilities(cells, given)


def test_mix_of_no_rows(no_docs):
    assert mixing.mix(no_docs).count() == 0
