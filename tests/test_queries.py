"""Registered queries against their SQL, as the driver compares them, on the smallest tables."""

from __future__ import annotations

import math
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from playlore.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_its_sql(spark, tables, name):
    made = plans.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    got = sorted(str([_plain(r[c]) for c in columns]) for r in made.collect())
    want = tables.execute(plans.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert got == sorted(str([_plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())


def test_cells_round_as_their_sql_and_keep_the_sign_of_zero(spark, tmp_path):
    con = duckdb.connect()
    balances = "-990.0 -630.0 -180.0 -90.0 -0.0 0.0 90.0 -0.004 -0.005 0.005 1.005 -1.005 143.855 -291.135 584.755 0.125 -0.375 89.995 -89.995 30.0 537.46".split()
    rows = ", ".join(f"({i}, CAST('{b}' AS DOUBLE))" for i, b in enumerate(balances))
    con.execute(f"COPY (SELECT CAST(k AS BIGINT) AS s_suppkey, b AS s_acctbal FROM (VALUES {rows}, (99, NULL)) t(k, b)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    got = sorted(tuple(r) for r in plans.QUERIES["cells"](spark, str(tmp_path)).select("s_suppkey", "miles", "cell", "outside").collect())
    assert got == sorted(con.execute(plans.ORACLES["cells"]).fetchall())
    assert got[1][2:] == ("-0.00,-90.00", "-0.00,-90.00")


LARGER = "/root/testdata/sf0.01"


def test_queries_without_sql_are_known():
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"modes", "recommended", "background"}


def test_modes_cover_each_listener(spark):
    made = plans.QUERIES["modes"](spark, LARGER).collect()
    users = {r.user_id for r in made}
    assert len(users) == 20
    for u in users:
        theirs = [r for r in made if r.user_id == u]
        assert 2 <= len(theirs) <= 8 and abs(sum(r.share for r in theirs) - 1) < 0.01 and all(r.coverage == 1.0 for r in theirs)


def test_recommended_are_six_unplayed_artists_of_each_mode(spark):
    made = plans.QUERIES["recommended"](spark, LARGER).collect()
    assert made and all(r.artist.startswith("vector ") for r in made)
    by = {}
    for r in made:
        by.setdefault((r.user_id, r["mode"]), []).append((r["rank"], r.score))
    assert all([n for n, _ in sorted(v)] == list(range(1, 7)) and [s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in by.values())


def test_background_is_the_same_sample_of_the_points_each_time(spark):
    first, again = (plans.QUERIES["background"](spark, SF).collect() for _ in range(2))
    assert len({r.artist for r in first}) == 200 and first == again


def test_songs_move_up(spark):
    assert plans.QUERIES["songs_up"](spark, LARGER).count() > 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_works_without_the_training_data_operators(tmp_path, pipeline_stays):
    root = pathlib.Path(__spark_entry__.__file__).parent
    gone = {"llm", ".git", "__pycache__"} | (set() if pipeline_stays else {"corpus_pipeline.py"})
    shutil.copytree(root, tmp_path / "copy", ignore=lambda _, names: gone & set(names))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('playlore.plans.queries', fromlist=['x']).QUERIES), len(e.oracle_sql()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
    assert told.stdout.split() == ["True", str(len(plans.ORACLES))], told.stderr


def test_the_rest_does_not_import_the_training_data_operators():
    root = pathlib.Path(plans.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
    assert sys.modules
