import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinfold.operators import extract, linkage
from kinfold.plans.queries import QUERIES
from kinfold.sources import testbed

#: Orders below and above those whose row ids a long holds.
ORDERS = [0, 1, 149_999, 18_014_397, 18_014_399, 36_028_797, 54_000_000, 400_000_000]
PARTS = [(1, 3), (7_200_000, 360_000)]


@pytest.fixture
def folder(tmp_path):
    lines = [(o, p, s, n, q, "A", d) for o in ORDERS for p, s in PARTS for n, q, d in ((1, 1.0, "F"), (7, 50.0, "O"))]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    line = pa.table(dict(zip(names, map(list, zip(*lines, strict=True)), strict=True)))
    line = line.set_column(3, "l_linenumber", line["l_linenumber"].cast(pa.int32()))
    tables = {
        "lineitem": line,
        "orders": pa.table({"o_orderkey": ORDERS, "o_custkey": [5] * len(ORDERS)}),
        "part": pa.table(
            {
                "p_partkey": [p for p, _ in PARTS],
                "p_name": ["long green steel pipe of the northern works"] * 2,
                "p_brand": ["Brand#1"] * 2,
                "p_type": ["LARGE"] * 2,
                "p_size": pa.array([3, 4], pa.int32()),
            }
        ),
        "supplier": pa.table(
            {"s_suppkey": [s for _, s in PARTS], "s_name": ["one", "two"], "s_nationkey": pa.array([1, 2], pa.int32())}
        ),
    }
    for name, table in tables.items():
        pq.write_table(table, tmp_path / f"{name}.parquet")
    return str(tmp_path), lines


def test_row_ids_beyond_a_long_are_those_modulo_two_to_64(spark, folder):
    """Before, any order from 18,014,399 on stopped the query with an overflow."""
    path, lines = folder
    exact = [(((o * 8 + n) * 100000 + p) * 10000 + s) * 64 + int(q) for o, p, s, n, q, _, _ in lines]
    want = sorted((x + 2**63) % 2**64 - 2**63 for x in exact)
    got = sorted(r["row_id"] for r in testbed.relationships(spark, path).select("row_id").collect())
    assert got == want and len(set(got)) == len(lines)
    assert any(x >= 2**63 for x in exact) and {x for x in exact if x < 2**63} <= set(got)


@pytest.mark.parametrize("name", ["E_key_pairs", "E_key_truth", "E_key_confusion", "E_key_overlap", "R_org_profile"])
def test_queries_take_large_orders(spark, folder, name):
    assert QUERIES[name](spark, folder[0]).count() > 0


def test_records_of_large_orders_keep_their_ids(spark, folder):
    combined = extract.combined(*testbed.domains(spark, folder[0]))
    records = linkage.linkage_records(combined)
    ids = [r["record_id"] for r in records.collect()]
    assert ids and len(set(ids)) == len(ids)
