"""The driver contract, and that the library stands without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from numbers import Number
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
#: One query of each kind is compared here; the driver compares all.
SAMPLE = ["a1_panel_tally", "a12_impacts", "a17_outcomes", "a19_key_health", "h2_h3_t10_normal_hashes", "j2_similar_articles", "s10_upsert", "t8_h4_canonical_urls", "w4_w6_event_decisions", "w12_g8_publish_gate"]


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "matched_id", "decision"] and entry.entry(spark).count() > 0


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    return str(bool(v)) if type(v).__name__ in ("bool", "bool_") else repr(round(float(v), 6) + 0.0) if isinstance(v, Number) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    n, llm = said.stdout.split()[-2:]
    assert int(n) > 80 and llm == "False", said.stderr
