import re
from pathlib import Path

import duckdb
import pytest
from support import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from kinfold.sources.worktable import work_folder

CHECKED = [
    "R_combined",
    "R_focus_documents",
    "R_exact_duplicates",
    "D_similar_pairs",
    "V_sweep_groups",
    "R_validated_members",
    "R_org_profile",
    "D_optimal_threshold",
    "E_cluster_metrics",
]


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SMALL)
    answer = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    want = sorted(answer.fetchall(), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want


def test_entry(spark):
    groups = entry(spark)
    assert groups.columns == ["group_id", "member_id"]
    assert groups.count() == 48 and groups.select("group_id").distinct().count() == 23


def test_every_statement_belongs_to_a_query():
    assert oracle_sql().keys() <= queries().keys()


def test_work_folder_comes_from_the_session(spark):
    assert work_folder(spark).startswith(
        (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    )


def test_no_lineage_shortcuts_or_driver_pulls_in_operators():
    package = Path(__file__).parents[1] / "kinfold"
    for path in package.rglob("*.py"):
        if "llm" in path.relative_to(package).parts:
            continue  # has a rule of its own beside its tests
        code = path.read_text()
        assert not re.search(r"localCheckpoint|\.crossJoin\(|\.toPandas\(|\.collect\(\)", code), path
