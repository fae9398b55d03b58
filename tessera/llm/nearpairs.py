"""Problem 2: near-duplicate records by a parity-sketch join.

Every word flips one bit of a wide sketch (2^20 bits, kept as the list of bits it touches) and one of a folded sketch of 128
bits that travels with the keys.  Let A and B be word sets of sizes a and b with Jaccard similarity >= t, and let
c = ceil(t / (1 + t) (a + b)) be the least number of words they then share.  They differ in at most a + b - 2c words, and so
do their sketches in as many bits: the Hamming distance never exceeds the symmetric difference.

* Size bands.  Sizes fall into geometric bands; a pair of bands that can hold similar sets has its own keys, so that a set
  knows the least size of its partner and with it the most bits m = a - c that the partner can lack.
* Pigeonhole.  Of any m + 1 bits that A touches at least one is touched by B, of any m + d at least d.  Bits are taken in one
  global order, the rarest first: the d first common bits of a pair lie among the first m + d bits of both sides.  So all
  combinations of d such bits are keys, and similar sets agree in one.
* Crowded keys split.  A key whose bits are so frequent that more than ``crowd`` sets are expected to hold it takes one bit
  more, again and again.  The expectation follows from the bits of the key alone, so both sides take the same decision and
  no pair is lost; depth grows with the logarithm of the number of sets.  No key has a cut-off and no set is left out.
* Verification.  Pairs that meet are pruned by size and by the Hamming distance of the folded sketches, then compared by
  their words.

Equal word sets collapse to one class first, so groups of copies never meet themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.cluster import cut

SKETCH_BITS = 1 << 20  # counts of bits are held by the driver and broadcast: 4 MB, whatever the input
CROWD, DAMP = 300, 0.5  # words go together, so a further bit counts with the root of its share of sets
BANDS = 2  # size bands in the range of sizes that a set can be similar to
CHUNK = 200_000  # words expanded at once


def words(*cols: Column) -> Column:
    """Distinct words: lower-cased runs of letters and digits over the columns joined by a space; null is empty."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _xor_where(tokens: Column, keep, value) -> Column:
    return F.aggregate(F.filter(tokens, keep), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(value(x)))


def _lane(tokens: Column, lanes: int, i: int) -> Column:
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)).cast("int"))
    return _xor_where(tokens, lambda x: x.bitwiseAND(F.lit(lanes - 1)) == i, bit)


def parity_sketch(tokens: Column, lanes: int = 4) -> Column:
    """lanes * 64 bits; each token flips one, so that Hamming distance <= size of the symmetric difference."""
    return F.struct(*[_lane(tokens, lanes, i).alias(f"s{i}") for i in range(lanes)])


def token_sets(rows: DataFrame) -> DataFrame:
    """(id, tok) of the rows (id, words) that have words: their hashes, sorted, so that equal sets are equal arrays."""
    return rows.where(F.size("words") > 0).select("id", F.array_sort(F.transform("words", lambda w: F.xxhash64(w))).alias("tok"))


def _classes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("tok").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "tok", F.size("tok").alias("size"))


def text_classes(rows: DataFrame) -> DataFrame:
    """(rep, copies, tok, size) per distinct word set; ``rows`` has id and words.  Rows without any word take no part."""
    return _classes(token_sets(rows))


def band_edges(most: int, t: float) -> np.ndarray:
    """Least sizes of the bands, up to the first beyond ``most``."""
    step, edges = (1 / t) ** (1 / BANDS), [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * step + 1e-9)))
    return np.array(edges, np.int64)


def shared(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The least number of common words of sets of these sizes with similarity >= t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (x.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def pigeonholes(size: np.ndarray, bits: np.ndarray, start: np.ndarray, share: np.ndarray, sets: int, t: float, crowd: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, key, side): the keys of each set; side 0 is the lower band of a pair of bands, 1 the upper one, 2 both.

    ``bits`` are the ranks of the touched bits, ascending within each row of ``start``; ``share`` is the part of all sets that
    hold the bit of a rank.
    """
    held = np.diff(start)
    edges = band_edges(int(size.max() / t) + 1, t)
    band = np.searchsorted(edges, size, side="right") - 1
    first, last = np.ceil(size * t - 1e-9).astype(np.int64), np.floor(size / t + 1e-9).astype(np.int64)
    reach = np.searchsorted(edges, first, side="right") - 1, np.searchsorted(edges, last, side="right") - 1
    for step in range(int((reach[0] - band).min()), int((reach[1] - band).max()) + 1):
        other = band + step
        row = np.nonzero((other >= reach[0]) & (other <= reach[1]))[0]
        if not len(row):
            continue
        lacks = size - shared(size, np.maximum(edges[np.clip(other, 0, len(edges) - 1)], first), t)
        key = _mix(_mix(np.full(len(row), 7, np.uint64), np.minimum(band, other)[row]), np.maximum(band, other)[row])
        at, expected, depth = np.zeros(len(row), np.int64), np.full(len(row), np.log(max(sets, 1))), 0
        while len(row):
            depth += 1
            end = np.minimum(lacks[row] + depth, held[row])
            many = np.maximum(0, end - at)
            of = np.repeat(np.arange(len(row)), many)
            place = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            bit = bits[start[row[of]] + place]
            row, key, at = row[of], _mix(key[of], bit), place + 1
            expected = expected[of] + np.log(share[bit]) * (1.0 if depth == 1 else DAMP)
            crowded = expected > np.log(crowd)
            # a pair may share no further bit: a key that holds the least number of common bits is final as well
            final = ~crowded | (depth >= (held - lacks)[row])
            yield row[final], key[final], 2 if step == 0 else int(step < 0)
            row, key, at, expected = row[crowded], key[crowded], at[crowded], expected[crowded]


def _keys(t: float, crowd: float, ranks, counts, sets: int):
    def chunk(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        size = pdf["size"].to_numpy(np.int64)
        row = np.repeat(np.arange(len(pdf)), size)
        token = np.concatenate(pdf["tok"].to_list()).astype(np.int64)
        touched = np.unique(row * SKETCH_BITS + ranks.value[token & (SKETCH_BITS - 1)])
        start = np.searchsorted(touched, np.arange(len(pdf) + 1) * SKETCH_BITS)
        rep, k0, k1 = (pdf[c].to_numpy(np.int64) for c in ("rep", "s0", "s1"))
        for r, key, side in pigeonholes(size, touched % SKETCH_BITS, start, counts.value / max(1, sets), sets, t, crowd):
            for lo in range(0, len(r), 100_000):
                x = r[lo : lo + 100_000]
                yield pd.DataFrame({"key": key[lo : lo + 100_000].view(np.int64), "rep": rep[x], "side": np.full(len(x), side, np.int32), "size": size[x].astype(np.int32), "k0": k0[x], "k1": k1[x]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(np.cumsum(pdf["size"].to_numpy()) // CHUNK, sort=False):
                yield from chunk(part)

    return run


def similar_classes(classes: DataFrame, t: float, crowd: float = CROWD) -> DataFrame:
    """(a, b, similarity), a < b: every pair of ``classes`` (see text_classes) with Jaccard similarity >= t; no pair is dropped."""
    base = cut(classes.select("rep", "size", "tok", parity_sketch(F.col("tok"), 2).alias("sk")).select("rep", "size", "tok", "sk.*"))
    sc, sets = base.sparkSession.sparkContext, base.count()
    seen = base.select(F.explode("tok").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(SKETCH_BITS - 1)).alias("bit")).agg(F.count("*").alias("n")).toPandas()  # at most SKETCH_BITS rows
    count = np.zeros(SKETCH_BITS, np.int64)
    count[seen["bit"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    order = np.argsort(count, kind="stable")
    rank = np.empty(SKETCH_BITS, np.int32)
    rank[order] = np.arange(SKETCH_BITS, dtype=np.int32)
    ranks, counts = sc.broadcast(rank), sc.broadcast(np.minimum(count[order], max(1, sets)).astype(np.float32))
    keyed = base.mapInPandas(_keys(t, crowd, ranks, counts, sets), "key long, rep long, side int, size int, k0 long, k1 long")
    keyed = keyed.hint("merge")  # the optimiser takes them for as few as the sets and would broadcast them
    x, y = keyed.alias("x"), keyed.alias("y")
    apart = F.bit_count(F.col("x.k0").bitwiseXOR(F.col("y.k0"))) + F.bit_count(F.col("x.k1").bitwiseXOR(F.col("y.k1")))
    sa, sb = F.col("x.size"), F.col("y.size")
    # one condition over both sides, so that both read the same exchange
    sides = (F.col("x.side") * 3 + F.col("y.side") == 1) | ((F.col("x.side") * 3 + F.col("y.side") == 8) & (F.col("x.rep") < F.col("y.rep")))
    near = (F.least(sa, sb) >= F.ceil(F.greatest(sa, sb) * t - 1e-9)) & (apart <= sa + sb - 2 * F.ceil(F.lit(t / (1 + t)) * (sa + sb) - 1e-9))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & sides & near).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    ta, tb = base.select(F.col("rep").alias("a"), F.col("tok").alias("ta")), base.select(F.col("rep").alias("b"), F.col("tok").alias("tb"))
    both = met.join(ta, "a").join(tb, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    sim = F.col("common") / (F.size("ta") + F.size("tb") - F.col("common"))
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= t - 1e-12)


def near_pairs(rows: DataFrame, t: float, expand: int = 64) -> DataFrame:
    """(record_a, record_b): rows (id, words) with similarity >= t, record_a < record_b.

    Links between different word sets hold between all their rows where a set has at most ``expand`` rows; of a larger
    group of copies the smallest id stands for all in links to other sets.  Within a group of copies each row is paired
    with the smallest id, and with every other row if the group has at most ``expand``; so every row stays linked.
    """
    sets = cut(token_sets(rows))
    classes = cut(_classes(sets))
    links = cut(similar_classes(classes, t))
    key = F.xxhash64("tok").alias("k")
    reps = classes.where("copies > 1").select(key, "tok", "rep", "copies")
    dup = cut(sets.select("id", key, "tok").join(reps, ["k", "tok"]).select("rep", "id", "copies"))
    star = dup.where("id <> rep").select(F.col("rep").alias("x"), F.col("id").alias("y"))
    small = dup.where(F.col("copies") <= expand)
    inner = small.select("rep", F.col("id").alias("x")).join(small.select("rep", F.col("id").alias("y")), "rep").where("x < y and x <> rep").select("x", "y")
    of = small.select("rep", "id")
    pa, pb = of.select(F.col("rep").alias("a"), F.col("id").alias("x")), of.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    cross = links.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    return star.union(inner).union(cross).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def near_groups(rows: DataFrame, t: float) -> DataFrame:
    """One row per record: id, the group it belongs to (smallest class of its component) and the number of linked texts."""
    from tessera.llm.components import components

    sets = cut(token_sets(rows))
    classes = cut(_classes(sets))
    links = cut(similar_classes(classes, t).select("a", "b"))
    comp = cut(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    first = comp.groupBy("component").agg(F.min("node").alias("first"))
    comp = comp.join(first, "component").select("node", F.col("first").alias("component"))
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    key = F.xxhash64("tok").alias("k")
    label = classes.select("rep", "copies", "tok").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    label = label.select(key, "tok", "copies", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    placed = sets.select("id", key, "tok").join(label, ["k", "tok"]).select("id", "group_id", "copies", "links")
    bare = rows.where("size(coalesce(words, array())) = 0").select("id", F.col("id").alias("group_id"), F.lit(1).alias("copies"), F.lit(0).alias("links"))
    return placed.union(bare).withColumnRenamed("id", "record_id")
