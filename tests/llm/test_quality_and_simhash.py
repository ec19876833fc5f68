import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm import quality, simhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    """The contract's base numbers by brute force."""
    words = SPLIT.findall(text or "")
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {k + i for k, g in enumerate(grams) if seen[g] > 1 for i in range(5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPLIT.search(line):
            dup += line in lines
            lines.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


EDGE_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e a b c d e",
    "a a a a a a a a a a a",
    "x\ny\nx\nx\n \n \n",
    "é|é <b> *** $5 & 100% joined   word\x1cstill",
    " ".join(f"w{k % 7}" for k in range(3000)),
    "\x0b\x0ca\rb",
    "ends here\n",
]


def counted(docs, texts):
    rows = quality.measured(docs(texts)).select("doc_id", *quality.COUNTS, "base_failed").collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_counts_equal_brute_force(docs, small):
    got = counted(docs, EDGE_TEXTS)
    for k, text in enumerate(EDGE_TEXTS):
        assert got[k] == base_counts(text), repr(text)
    measured = {r["doc_id"]: r for r in quality.measured(small).collect()}
    for row in small.collect():
        r = measured[row["doc_id"]]
        assert tuple(r[c] for c in [*quality.COUNTS, "base_failed"]) == base_counts(row["text"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té|#", max_size=60), min_size=1, max_size=30))
def test_counts_of_any_text(spark, texts):
    rows = [(k, t, "en", "a", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in quality.measured(df).collect():
        assert tuple(r[c] for c in [*quality.COUNTS, "base_failed"]) == base_counts(r["text"])


def plain(k):
    return " ".join(f"word{(k * 31 + i * 7) % 997}" for i in range(60))


def test_thresholds_follow_the_group(docs):
    """Symbols that are usual in one source are an outlier in another; clean rows stay."""
    rows = [(k, plain(k), "en", "prose") for k in range(80)]
    rows += [(100 + k, plain(k).replace(" ", " | "), "xx", "tables") for k in range(80)]
    rows += [(900, plain(900).replace(" ", " | "), "en", "prose"), (901, plain(901), None, None), (902, None, "en", "prose")]
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs(rows)).collect()}
    assert all(kept[k] for k in range(80)) and all(kept[100 + k] for k in range(80))
    assert not kept[900] and kept[901] and not kept[902]


def test_sketches_merge_in_any_order(docs):
    rows = [(k, plain(k) + " |" * (k % 9), "en", f"s{k % 3}") for k in range(90)]
    measures = quality.measured(docs(rows))
    whole = quality.sketched(measures, ["lang"])
    parts = quality.merged(quality.sketched(measures, ["lang", "source"]), ["lang"])
    assert sorted(whole.collect()) == sorted(parts.select(whole.columns).collect())


def test_quality_plan_is_native(small):
    plan = quality.measured(small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_quality_edges(docs, spark):
    assert quality.verdicts(docs([])).count() == 0
    clashing = docs([(1, plain(1), "en", "a"), (1, plain(1), "en", "a")]).withColumn("n_words", F.lit("x"))
    assert [r["n_words"] for r in quality.verdicts(clashing).collect()] == [60, 60]
    accepted = quality.accepted(clashing)
    assert accepted.columns == clashing.columns and accepted.count() == 2


def fingerprint(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = SPLIT.findall(lowered)
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    ids = sorted(prints)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    values = np.array([prints[k] for k in ids], dtype=np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= bits), strict=True):
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("text", EDGE_TEXTS + ["ÀB Cd ef GH", "A b", "İstanbul DİYE x y"])
def test_fingerprint_is_the_contracts(text):
    assert simhash.fingerprint((text or "").encode(), 3) == fingerprint(text)


def test_components_equal_brute_force(small):
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in small.collect()}
    got = simhash.components(small).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints, 2)


@pytest.mark.parametrize(("bits", "chunk"), [(0, 2048), (1, 2048), (2, 2048), (2, 8), (3, 16)])
def test_links_find_planted_neighbours(spark, bits, chunk):
    rng = np.random.default_rng(bits)
    values = set(rng.integers(0, 1 << 64, 60, dtype=np.uint64).tolist())
    for value in sorted(values)[:40]:
        for flips in range(1, bits + 2):
            for bit in rng.choice(64, flips, replace=False):
                value ^= 1 << int(bit)
            values.add(value)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    links = simhash.bucket_links(spark.createDataFrame(signed, "fp long"), bits, chunk).collect()
    want = brute_components({k: v[0] % (1 << 64) for k, v in enumerate(signed)}, bits)
    at = {v[0]: k for k, v in enumerate(signed)}
    root = dict.fromkeys(range(len(signed)))
    group = {k: {k} for k in root}
    for r in links:
        assert ((r["i"] ^ r["j"]) % (1 << 64)).bit_count() <= 64
        a, b = group[at[r["i"]]], group[at[r["j"]]]
        if a is not b:
            a |= b
            for k in b:
                group[k] = a
    assert {k: min(g) for k, g in group.items()} == want


def test_simhash_edges(docs):
    rows = docs([None, "", "same words here now", "same words here now", "other things entirely unlike"])
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(rows).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert simhash.components(docs([])).count() == 0
    kept = simhash.survivors(rows.unionByName(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4] and kept.columns == rows.columns


def test_survivors_are_one_of_each_group(docs):
    copy, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, copy, "en", "a"), (1, other, "en", "a"), (2, copy, "en", "a"), (None, other, "en", "b"),
            (None, "thirteen fourteen fifteen sixteen", "en", "b"), (3, copy, "en", "a"), (1, copy, "en", "a"),
            (4, None, None, None), (5, "", "en", "a")]
    kept = simhash.survivors(docs(rows).selectExpr("*", "7 AS fp", "8 AS node")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(
        [(1, copy), (1, other), (None, "thirteen fourteen fifteen sixteen"), (4, None)], key=repr)
    assert simhash.survivors(docs([])).count() == 0
