"""Problem 7: train/validation/test splits that keep related records together.

Rows tied by a shared question or a shared database form components.  The bipartite graph is first contracted exactly: per
question, its databases are linked to the smallest one, so that a hot database never becomes an adjacency list.  Components
come from frontier breadth-first search; they are dealt to the splits in the order of their hash by running row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.operators.prefix import running_sum
from tessera.plans.cluster import cut

BUCKETS, BIG, MOST_SPLITS = 256, 50, 1000


def ties(rows: DataFrame) -> DataFrame:
    """(src, dst): databases that share a question, each linked to the smallest of that question.  rows: id, a, b."""
    pairs = cut(rows.where("a is not null and b is not null").select("a", "b").distinct())
    anchor = pairs.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("x")).where("m <> x").select("b", "m")
    return pairs.join(anchor, "b").where("a <> m").select(F.col("m").alias("src"), F.col("a").alias("dst"))


def tied_entities(rows: DataFrame) -> DataFrame:
    """(node, component) of the entities ``a`` that share a component with another."""
    return components(ties(rows))


def component_rows(rows: DataFrame) -> DataFrame:
    """(id, component) of every row: by its entity a, else by another row of its b, else b itself, else alone."""
    comp = cut(tied_entities(rows))
    lone = rows.where("a is null and b is not null").select("b").distinct()
    via = rows.where("a is not null and b is not null").join(lone, "b").groupBy("b").agg(F.min("a").alias("via"))
    known = rows.where("a is not null").select("id", F.col("a").alias("node"))
    other = rows.where("a is null").join(via, "b", "left").select("id", F.coalesce("via", F.concat(F.lit("\u0000b:"), F.col("b").cast("string")), F.concat(F.lit("\u0000r:"), F.col("id").cast("string"))).alias("node"))
    return known.union(other).join(comp, "node", "left").select("id", F.coalesce("component", "node").alias("component"))


def assign_splits(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, component, split_name) of every row; ``targets`` (split_name, target_bp) is a short stated list.

    A component larger than a ``BIG``-th of the smallest split is placed first, the largest first: where the largest part of
    the room is left among the splits of which it would take at most a quarter of the room, else where most room is left.
    There are at most BIG / smallest share of these, whatever the input.  All others follow in hash order and fill what
    remains of each split in turn, so that shares are met to about a BIG-th.
    Null a and b make a row its own component; no rows give no rows.
    """
    stated = targets.where("split_name is not null and target_bp > 0").orderBy(F.desc("target_bp"), "split_name").limit(MOST_SPLITS + 1).collect()
    if len(stated) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    shares = [(r["split_name"], int(r["target_bp"])) for r in stated]
    if not shares:
        raise ValueError("no split has a positive share")
    member = cut(component_rows(rows))
    sizes = cut(member.groupBy("component").agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = sum(bp for _, bp in shares)
    room = {name: total * bp / whole for name, bp in shares}
    goal, big = dict(room), max(1.0, min(room.values()) / BIG)
    placed = []
    for r in sizes.where(F.col("n") > big).orderBy(F.desc("n"), "component").collect():  # bounded: each holds a fixed share of all rows
        fits = [x for x in room if r["n"] <= room[x] / 4]
        name = max(fits, key=lambda x: room[x] / goal[x]) if fits else max(room, key=lambda x: room[x])
        room[name] -= r["n"]
        placed.append((r["component"], name))
    rest = running_sum(sizes.where(F.col("n") <= big).withColumn("key", F.xxhash64("component")).withColumn("g", F.lit(0)), ["g"], "key", "component", "n", BUCKETS)
    left = sum(max(0.0, v) for v in room.values())
    rows_left = sizes.where(F.col("n") <= big).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    choice, upto = F.lit(shares[-1][0]), 0.0
    marks = []
    for name, _ in shares:
        upto += max(0.0, room[name]) / left * rows_left if left else 0.0
        marks.append((upto, name))
    for upto, name in reversed(marks[:-1]):
        choice = F.when(F.col("before") + F.col("n") / 2 < upto, F.lit(name)).otherwise(choice)
    where = rest.select("component", choice.alias("split_name"))
    if placed:
        where = where.union(rows.sparkSession.createDataFrame(placed, "component string, split_name string"))
    return member.join(where, "component").select("id", "component", "split_name")
