"""Rules that hold for all modules of the subpackage."""

import re
from pathlib import Path

PACKAGE = Path(__file__).parents[2] / "kinfold" / "llm"

# Reads into the driver: each has a bound that its module states.
BOUNDED = {
    "sharding.py": 2,  # rows by shard and wanted shard; rows by shard
    "toxicity.py": 2,  # chosen words; word numbers of the sample
    "langid.py": 2,  # rows by language; the sample's texts
    "secret_scan.py": 1,  # names of the dictionary
    "url_filter.py": 1,  # rows by label
    "vector_codes.py": 2,  # entries of the codebooks: the first rows, and their sums
    "alignment.py": 1,  # a slice of the pair counts
}


def test_only_bounded_tables_reach_the_driver():
    for path in PACKAGE.glob("*.py"):
        code = path.read_text()
        assert not re.search(r"localCheckpoint|\.crossJoin\(|\.toPandas\(", code), path
        assert len(re.findall(r"\.collect\(\)|\.toArrow\(\)", code)) <= BOUNDED.get(path.name, 0), path


def test_nothing_else_imports_the_subpackage():
    for path in PACKAGE.parent.rglob("*.py"):
        if PACKAGE not in path.parents:
            assert "kinfold.llm" not in path.read_text(), path
