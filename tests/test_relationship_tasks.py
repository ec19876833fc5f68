from pathlib import Path

import pyarrow.compute as pc
import pyarrow.parquet as pq
from support import SMALL, as_set

from kinfold.sources import testbed, worktable


def test_spread_makes_more_partitions_of_a_larger_table(spark):
    """Before, one partition a core, however large the table."""
    cores = spark.sparkContext.defaultParallelism
    rows = 4 * cores * worktable.SPREAD_BYTES // 8
    few, many = (worktable.spread(spark.range(n), "id") for n in (100, rows))
    assert few.rdd.getNumPartitions() == cores and many.rdd.getNumPartitions() == 4 * cores


def test_order_lines_meet_orders_in_as_many_tasks_as_their_size_asks_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(worktable, "SPREAD_BYTES", 1 << 10)
    for name in ("lineitem", "part", "supplier", "orders"):
        pq.write_table(pq.read_table(Path(SMALL) / f"{name}.parquet"), tmp_path / f"{name}.parquet")
    got = testbed.relationships(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("p_partkey") < plan.index("o_orderkey")  # the outer join comes first in the plan
    count = int(plan.split("RepartitionByExpression")[1].split("], ")[1].split("\n")[0].split(",")[0])
    assert count > spark.sparkContext.defaultParallelism
    lines = pc.count_distinct(pq.read_table(Path(SMALL) / "lineitem.parquet")["l_orderkey"]).as_py()
    assert got.select("document_number").distinct().count() == lines
    assert as_set(got.select("domain").distinct()) == {("F",), ("O",)}
