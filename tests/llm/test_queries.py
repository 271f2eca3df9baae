from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from check_oracles import connect, difference
from decoyscope.llm.oracles import ORACLES
from decoyscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_all_dealt_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_a_row_per_input_row(spark, name):
    table = {"op2": "pages", "op11": "conversations"}.get(name.split("_")[0], "documents")
    found = QUERIES[name](spark, SF)
    key = found.columns[0]
    each = "DISTINCT" if name.startswith("op11") else ""  # a row per conversation
    want = duckdb.sql(f"SELECT {each} {key} FROM '{SF}/{table}.parquet'").fetchall()
    rows = found.collect()
    assert sorted(r[key] for r in rows) == sorted(k for k, in want)
    if name.startswith("op2_"):
        assert all(r.n_chars == len(r.text) for r in rows)


def test_digest_columns(spark):
    row = QUERIES["op1_fm_index_decontamination"](spark, SF).where("not contaminated").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
