"""Sharding by balanced label propagation.

Linked documents should share a shard, and shards should hold the same number of rows. Links are given
as hubs: documents of one hub are linked (for equal texts, the text's digest). Every linked document starts
in a shard by a hash of its id. In each round a hub counts its members by shard, and a
document is drawn to the shard where its hubs have most members. A shard takes movers only up to its
quota of rows: when more want in than it has room for, each is admitted with the same chance, told by a
hash. Documents without links pull nowhere and move nowhere; they fill the shards up at the end, so
links decide first and sizes still come out even. Rows end at most one apart.

Each round is two joins on documents and hubs with map-side sums between; a hub of any size is a count
by shard, and its members meet it through a join that adaptive execution splits when it is skewed. Only
tables of shards by shards reach the driver.

A hub above a quota cannot have one shard: its members are dealt by a hash over the shards that hold most of it, as many as its
rows need at ``FILL`` of a quota each. Rows are numbered in slices of hubs, and a hub of more than ``SLICE`` rows has slices of its own, so a group is cut
only where a shard ends, at every size of the table.

Nulls and edges: null texts are not linked to each other and have one byte of size; repeated ids with equal texts are separate
rows that are linked, told apart by a number; texts of any length count by their digest; extra columns are ignored; fewer rows
than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, placed, with_copies

SHARDS = 16
ROUNDS = 6
SEED = 3
#: Share of a quota that a hub above it plans with, so that small hubs keep room in its shards.
FILL = 0.6
#: Rows that are numbered by one task.
SLICE = 100_000


def chance(round_: int) -> Column:
    """A number in [0, 1) for each row and round, the same in every run."""
    draw = F.pmod(F.xxhash64("_row", F.lit(SEED + round_)), F.lit(1 << 30))
    return draw.cast("double") / F.lit(float(1 << 30))


def linked_hubs(rows: DataFrame) -> DataFrame:
    """Hubs of two rows or more; others link nothing."""
    return rows.where(F.col("_hub").isNotNull()).groupBy("_hub").agg(F.count("*").alias("_n")).where("_n > 1")


def wishes(state: DataFrame, quota: int) -> DataFrame:
    """Add ``_wish``: the shard where most of the row's hub is, the smaller one of equals.

    The ``_n`` rows of a hub above ``quota`` are dealt over as many of its first shards as they need to fill each to ``FILL``.
    """
    counts = state.groupBy("_hub", "shard").agg(F.count("*").alias("_held"))
    ranked = F.sort_array(F.collect_list(F.struct("_held", (-F.col("shard")).alias("_minus"))), asc=False)
    best = counts.groupBy("_hub").agg(ranked.alias("_best"))  # at most one entry a shard
    needed = F.when(F.col("_n") > quota, F.ceil(F.col("_n") / F.lit(max(1.0, FILL * quota)))).otherwise(F.lit(1))
    turn = F.pmod(F.xxhash64("_row", F.lit(SEED - 1)), F.least(needed, F.size("_best")).cast("long"))
    wish = -F.element_at("_best", (turn + 1).cast("int"))["_minus"]
    return state.join(best, "_hub").select(*state.columns, wish.cast("int").alias("_wish"))


def admitted(wished: DataFrame, quota: list[int], round_: int) -> DataFrame:
    """``wished`` after its moves: into each shard at most the rows that its quota leaves room for."""
    flows = wished.groupBy("shard", "_wish").agg(F.count("*").alias("_n")).collect()
    held, wanted = [0] * len(quota), [0] * len(quota)
    for flow in flows:
        held[flow["shard"]] += flow["_n"]
        if flow["shard"] != flow["_wish"]:
            wanted[flow["_wish"]] += flow["_n"]
    room = [max(0, q - h) for q, h in zip(quota, held, strict=True)]
    moving = [f for f in flows if f["shard"] != f["_wish"]]
    rates = [min(1.0, r / w) if w else 0.0 for r, w in zip(room, wanted, strict=True)]
    for _ in quota:  # rows that leave make room too, and what they make lets others leave
        out = [0.0] * len(quota)
        for flow in moving:
            out[flow["shard"]] += flow["_n"] * rates[flow["_wish"]]
        rates = [min(1.0, (r + o) / w) if w else 0.0 for r, o, w in zip(room, out, wanted, strict=True)]
    rate = F.element_at(F.array(*(F.lit(float(r)) for r in rates)), F.col("_wish") + 1)
    moves = (F.col("_wish") != F.col("shard")) & (chance(round_) < rate)
    return wished.withColumn("shard", F.when(moves, F.col("_wish")).otherwise(F.col("shard"))).drop("_wish")


def propagated(linked: DataFrame, shards: int, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (``_row``, ``_hub``, ...) with ``shard`` after ``rounds`` of label propagation."""
    start = F.pmod(F.xxhash64("_row", F.lit(SEED)), F.lit(shards)).cast("int")
    state = materialize(linked.withColumn("shard", start), "labels")
    for round_ in range(1, rounds + 1):
        wished = materialize(wishes(state, max(quota)), "wishes")
        if wished.where(F.col("_wish") != F.col("shard")).isEmpty():
            break
        state = materialize(admitted(wished, quota, round_), "labels")
    return state


def _sliced(df: DataFrame, n: int) -> DataFrame:
    """Add ``_slice``: a hash of the hub, then for hubs above ``SLICE`` rows one of the row."""
    own = F.when(F.col("_hub").isNull(), F.xxhash64("_row")).otherwise(F.xxhash64("_hub"))
    parts = F.greatest(F.ceil(F.col("_n") / SLICE), F.lit(1)).cast("long")
    part = F.pmod(F.xxhash64("_row", F.lit(SEED)), parts)
    of_hub = F.pmod(own, F.lit(max(1, -(-n // SLICE))).cast("long"))
    return df.withColumn("_slice", F.shiftleft(of_hub, 32) + part)


def sharded(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)`` of every row; ``slot`` counts a shard's rows from 0."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        key,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("_hub"),
        F.xxhash64(key, "text").alias("_same"),
        F.spark_partition_id().alias("_slice"),
    )
    rows = with_copies(materialize(rows, "rows"), "_same")
    rows = rows.withColumn("_row", F.xxhash64("_same", "_copy")).drop("_same", "_copy")
    rows = materialize(rows, "numbered")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    hubs = materialize(linked_hubs(rows), "hubs")
    linked = rows.join(hubs, "_hub")
    single = rows.join(hubs, "_hub", "left_anti").withColumn("_n", F.lit(1).cast("long"))
    state = propagated(linked, shards, quota, rounds)

    # Rows of a shard beyond its quota fill up others, like the rows without links.
    order = [F.col("_hub"), F.col("_row"), F.col(key), F.col("text_crc32")]
    held = materialize(placed(_sliced(state, n), ["shard"], order), "held")
    limits = F.element_at(F.array(*(F.lit(q) for q in quota)), F.col("shard") + 1)
    kept = held.where(F.col("place") < limits)
    over = held.where(F.col("place") >= limits).drop("shard", "place")
    counts = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    rest = over.unionByName(single.select(over.columns)).withColumn("_all", F.lit(0))
    filler = placed(_sliced(rest, n), ["_all"], order)
    begin, at = [], 0
    for s in range(shards):
        begin.append(at)
        at += quota[s] - counts.get(s, 0)
    target = F.greatest(*(F.when(F.col("place") >= b, F.lit(s)).otherwise(F.lit(-1)) for s, b in enumerate(begin) if quota[s] > counts.get(s, 0))) if at else F.lit(0)
    filled = filler.withColumn("shard", target.cast("int"))
    lookup = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("shard") + 1)
    slot = F.col("place") - lookup(begin) + lookup([counts.get(s, 0) for s in range(shards)])
    columns = [key, "size", "text_crc32", "shard"]
    return kept.select(*columns, F.col("place").alias("slot")).unionByName(
        filled.select(*columns, slot.cast("long").alias("slot"))
    )
