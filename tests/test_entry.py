"""The driver's contract: names, SQL agreement on the smallest data, independence of the optional package."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quireflow import session

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "-"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_others_run(spark, name):
    n = entry.queries()[name](spark, DATA).count()
    assert n > 0 or name == "p5_estimated"  # the smallest data have no archive without a zone


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_lives_without_the_text_package():
    code = "import sys; sys.modules['quireflow.llm'] = None; import __spark_entry__ as e; assert 'p3_found' in e.queries() and 'p6_ids' not in e.queries(); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr
    core = [p for p in (Path(entry.__file__).parent / "quireflow").rglob("*.py") if "llm" not in p.parts]
    assert core and not any(re.search(r"(import|from)\s+quireflow\.llm|from\s+quireflow\s+import\s+.*\bllm\b|import_module\(.*llm", p.read_text()) for p in core)


def test_only_the_text_package_itself_may_be_missing():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    there = (Path(entry.__file__).parent / "quireflow" / "llm").exists()
    assert (done.returncode != 0 and "regex" in done.stderr) if there else done.returncode == 0


def test_checkpoints_go_to_the_set_folder(spark):
    assert session.ensure_checkpoint_dir(spark).startswith(("file:" + spark.conf.get("spark.checkpoint.dir"), spark.conf.get("spark.checkpoint.dir")))
