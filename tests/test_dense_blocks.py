import numpy as np
import pyarrow as pa
import pytest

from kinfold.operators import dense


def test_a_dense_row_is_sent_once_for_each_large_block():
    assert dense.block_count(320_000, 4) == 20


@pytest.mark.parametrize("same", [True, False])
def test_products_of_a_large_block_are_cut(monkeypatch, same):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((30, 3))
    own = [0 if same or k < 17 else 1 for k in range(30)]
    table = pa.table({
        "row_id": pa.array(range(30), pa.int64()), "vector": vectors.tolist(), "own": pa.array(own, pa.int32()),
        "lo": pa.array([0] * 30), "hi": pa.array([0 if same else 1] * 30),
    })
    whole = {(p["i"], p["j"]) for p in dense._passing(table, 0.6).to_pylist()}
    links = dense._links(table, 0.6).to_pylist()
    monkeypatch.setattr(dense, "BLOCK_ROWS", 4)
    monkeypatch.setattr(dense, "FEW_PAIRS", 0)
    assert {(p["i"], p["j"]) for p in dense._passing(table, 0.6).to_pylist()} == whole

    def components(pairs):
        label = list(range(30))
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
        return len(set(label))

    cut = dense._links(table, 0.6).to_pylist()
    counts = {components([(p["i"], p["j"]) for p in found]) for found in (links, cut)} | {components(whole)}
    assert len(counts) == 1 and len(links) == 30 - counts.pop()
