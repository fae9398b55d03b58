"""Problem 3: the k most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (sign flips and a Walsh-Hadamard transform, three times) and
assigned to the nearest signed axis.  In each of ``tables`` independent tables a vector is stored under its nearest axis
and looks up its ``probes`` nearest; candidates of a bucket are reranked by exact cosine.

The number of concatenated rotations follows from the number of vectors alone (``depths``): further rotations, the last one
with as many axes as keep about ``CELL_ROWS`` stored vectors in a cell, part the buckets into cells, and a vector meets the
cells of its nearest axes at every level.  So it is compared with about as many others however many there are, where the
first rotation alone would compare it with a fixed part of all.

A bucket with more than ``bucket_rows`` rows is cut into blocks of asking and of stored rows, and all of them meet each
other.  So the candidates, and with them the recall, are the same whatever the size of the buckets, and no task holds more
than two blocks.  Equal vectors collapse to one class first.  Vectors travel as float32; candidates are sifted in float32
and their cosines taken in float64 of these values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cluster import cut

TABLES, PROBES, BUCKET_ROWS, SEED = 10, 3, 4096, 20240229
CELL_ROWS = 128  # stored vectors that a cell holds at least; comparing fewer at once costs more than it saves
SIFT = 1e-5  # more than float32 can err in a cosine


def sound(rows: DataFrame, dim: int) -> DataFrame:
    """Rows (id, v) whose vector has ``dim`` finite values, not all zero, as array<double>; all others take no part."""
    v = F.col("v")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(fine).select("id", F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, copies, v) per distinct vector; ids are its k+1 smallest.  The group limit runs before the shuffle."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= k + 1)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """count x 3 x dim signs of the pseudo-rotations."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), size=(count, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length must be a power of two."""
    n, d, h = x.shape[0], x.shape[1], 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(np.float32(d))


def nearest_axes(x: np.ndarray, signs: np.ndarray, m: int, pairs: int | None = None) -> np.ndarray:
    """The m nearest signed axes of each rotated row, the nearest first: axis j as j, its negative as j + dim.

    With ``pairs`` only the first so many axes count, and dim is that number.
    """
    for s in signs:
        x = hadamard(x * s)
    x = x[:, :pairs]
    both = np.concatenate([x, -x], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :m] if m > 1 else both.argmax(axis=1)[:, None]


def _hash(dim: int, tables: int, probes: int, seed: int):
    full = 1 << (dim - 1).bit_length()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = rotations(full, tables, seed)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.zeros((len(pdf), full), np.float32)
            raw = np.stack(pdf["v"].to_numpy())
            x[:, :dim] = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            for t in range(tables):
                axes = nearest_axes(x, signs[t], probes)
                for p in range(probes):
                    yield pd.DataFrame({"rep": pdf["rep"], "t": t, "a": axes[:, p], "store": p == 0})

    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"rep": pdf["rep"], "vec": [np.asarray(v, np.float32).tobytes() for v in pdf["v"]]})


def depths(rows: int, dim: int, cell_rows: int = CELL_ROWS) -> list[tuple[int, int]]:
    """(axes, probes) of the rotations after the first: whole ones while buckets are large, a part of one for the rest.

    With d pairs of axes a vector probes about 2 d^0.43 of the 2 d cells, which keeps the recall of a level near 0.98.
    """
    full = 1 << (dim - 1).bit_length()
    out, bucket = [], rows / (2 * full)
    while bucket >= 4 * cell_rows and len(out) < 8:
        pairs = min(full, 1 << max(0, int(bucket / (2 * cell_rows)).bit_length() - 1))
        out.append((pairs, min(2 * pairs, int(np.ceil(2 * pairs**0.43)))))
        bucket /= 2 * pairs
    return out


def _cells(x: np.ndarray, ask: np.ndarray, deeper: list[tuple[int, int]], signs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stored rows, asking rows) of every cell that both reach, level by level."""
    todo = [(np.arange(len(x)), np.arange(len(ask)), 0)]
    while todo:
        held, asking, level = todo.pop()
        if level == len(deeper):
            yield held, asking
            continue
        pairs, probes = deeper[level]
        own, near = nearest_axes(x[held], signs[level], 1, pairs)[:, 0], nearest_axes(ask[asking], signs[level], probes, pairs)
        order = np.argsort(own, kind="stable")
        first = np.searchsorted(own[order], np.arange(2 * pairs + 1))
        row, col = np.repeat(asking, near.shape[1]), near.ravel()
        by = np.argsort(col, kind="stable")
        start = np.searchsorted(col[by], np.arange(2 * pairs + 1))
        for c in range(2 * pairs):
            if first[c] < first[c + 1] and start[c] < start[c + 1]:
                todo.append((held[order[first[c] : first[c + 1]]], row[by[start[c] : start[c + 1]]], level + 1))


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of every asking row; ties go to the smaller id."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], c[keep], s[keep]


def _rerank(dim: int, k: int, deeper: list[tuple[int, int]], tables: int, seed: int):
    full = 1 << (dim - 1).bit_length()

    def unit(vecs: pd.Series) -> np.ndarray:
        x = np.zeros((len(vecs), full), np.float64)
        x[:, :dim] = np.frombuffer(b"".join(vecs), np.float32).reshape(-1, dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, ask = pdf[pdf["store"]], pdf[pdf["ask"]]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(held) and len(ask):
            hx, hid, qy, qid = unit(held["vec"]), held["rep"].to_numpy(np.int64), unit(ask["vec"]), ask["rep"].to_numpy(np.int64)
            hf, qf = hx.astype(np.float32), qy.astype(np.float32)
            signs = [rotations(full, tables, seed + 1 + level)[key[0]] for level in range(len(deeper))]
            for h, a in _cells(hf, qf, deeper, signs):
                stored = np.ascontiguousarray(hf[h].T)
                for lo in range(0, len(a), 512):
                    part = a[lo : lo + 512]
                    s = qf[part] @ stored
                    s[qid[part][:, None] == hid[h][None, :]] = -2.0
                    take = min(k, s.shape[1])
                    # ties at the k-th place go to smaller ids: keep all that may reach the k-th value
                    kth = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take][:, None]
                    r, c = np.nonzero((s >= kth - SIFT) & (s > -1.5))
                    r, c = part[r], h[c]
                    out.append((r, hid[c], np.round(np.einsum("ij,ij->i", qy[r], hx[c]), 12)))
            q, c, s = _best(*(np.concatenate(x) for x in zip(*out)), k)
            return pd.DataFrame({"q": qid[q], "c": c, "cos": s})
        return pd.DataFrame({"q": out[0][0], "c": out[0][1], "cos": out[0][2]})

    return run


def nearest_classes(classes: DataFrame, dim: int, k: int, tables: int = TABLES, probes: int = PROBES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(q, near): for each class its candidates, best first, at most k structs (cos, c); ties go to the smaller id.

    ``classes`` is written, see ``vector_classes``.
    """
    deeper = depths(classes.count(), dim, cell_rows)
    hashed = classes.select("rep", "v").mapInPandas(_hash(dim, tables, probes, seed), "rep long, t int, a int, store boolean")
    hashed = cut(hashed)  # keys only; vectors are joined once their place is known
    # which buckets hold too many rows: counts only, no vectors; at most rows * tables * probes / bucket_rows buckets are hot
    hot = hashed.groupBy("t", "a").agg(F.count("*").alias("n"), F.count_if("store").alias("stored")).where(F.col("n") > bucket_rows)
    hot = hot.select("t", "a", F.ceil(F.col("n") / bucket_rows).cast("int").alias("ni"), F.greatest(F.ceil(F.col("stored") / bucket_rows), F.lit(1)).cast("int").alias("nj"))
    vectors = classes.select("rep", "v").mapInPandas(_packed, "rep long, vec binary")
    placed = hashed.join(hot, ["t", "a"], "left").join(vectors, "rep").select("rep", "vec", "store", "t", "a", F.coalesce("ni", F.lit(1)).alias("ni"), F.coalesce("nj", F.lit(1)).alias("nj"), F.xxhash64("rep").alias("h"))
    # in a block pair (i, j) stored rows of block j are held and rows of block i ask; one pair: both at once
    part = lambda n: F.pmod("h", n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = placed.select("rep", "vec", "t", "a", part("ni").alias("i"), each("nj").alias("j"), (F.col("store") & (F.col("ni") == 1)).alias("store"), F.lit(True).alias("ask"))
    held = placed.where("store and ni > 1").select("rep", "vec", "t", "a", each("ni").alias("i"), part("nj").alias("j"), F.lit(True).alias("store"), F.lit(False).alias("ask"))
    scored = asks.unionByName(held).groupBy("t", "a", "i", "j").applyInPandas(_rerank(dim, k, deeper, tables, seed), "q long, c long, cos double")
    best = scored.repartition("q").groupBy("q", "c").agg(F.max("cos").alias("cos"))
    return best.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), "c"))), 1, k).alias("near"))


def exact_classes(classes: DataFrame, dim: int, k: int, every: int = 50, block_rows: int = BUCKET_ROWS) -> DataFrame:
    """(q, near) as in ``nearest_classes``, but exact, for the stated queries: the classes whose id is divisible by ``every``.

    Queries and stored vectors are cut into blocks of at most about ``block_rows``, and every pair of blocks is compared.
    """
    packed = cut(classes.select("rep", "v").mapInPandas(_packed, "rep long, vec binary"))
    n = max(1, packed.count())
    ni, nj = -(-n // (every * block_rows)), -(-n // block_rows)
    part = lambda m: F.pmod(F.xxhash64("rep"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    zero = (F.lit(0).alias("t"), F.lit(0).alias("a"))
    asks = packed.where(F.col("rep") % every == 0).select("rep", "vec", *zero, part(ni).alias("i"), each(nj).alias("j"), F.lit(False).alias("store"), F.lit(True).alias("ask"))
    held = packed.select("rep", "vec", *zero, each(ni).alias("i"), part(nj).alias("j"), F.lit(True).alias("store"), F.lit(False).alias("ask"))
    scored = asks.union(held).groupBy("t", "a", "i", "j").applyInPandas(_rerank(dim, k, [], 1, SEED), "q long, c long, cos double")
    return scored.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), "c"))), 1, k).alias("near"))


def recall(rows: DataFrame, dim: int, k: int, every: int = 50, **how) -> DataFrame:
    """(queries, sought, found): how many of the exact nearest classes of the stated queries the hashing finds."""
    classes = cut(vector_classes(sound(rows, dim), k))
    exact = exact_classes(classes, dim, k, every).select("q", F.explode("near").alias("x")).select("q", "x.c")
    near = nearest_classes(classes, dim, k, **how).where(F.col("q") % every == 0).select("q", F.explode("near").alias("x")).select("q", "x.c", F.lit(1).alias("hit"))
    return exact.join(near, ["q", "c"], "left").agg(F.count_distinct("q").alias("queries"), F.count("*").alias("sought"), F.count("hit").alias("found"))


def nearest_rows(rows: DataFrame, dim: int, k: int, **how) -> DataFrame:
    """(id, neighbour, cosine): for each row (id, v) its k most similar other rows; ties go to the smaller id.

    Null, short, all-zero and non-finite vectors take no part; fewer than k others give fewer neighbours.
    """
    valid = cut(sound(rows, dim))
    classes = cut(vector_classes(valid, k))
    near = nearest_classes(classes, dim, k, **how)
    ids = classes.select("rep", "ids")
    other = (
        near.select("q", F.explode("near").alias("x")).select("q", F.col("x.c").alias("rep"), (-F.col("x.far")).alias("cos"))
        .join(ids, "rep").select("q", F.explode(F.slice("ids", 1, k)).alias("id"), "cos")
    )
    own = ids.where(F.size("ids") > 1).select(F.col("rep").alias("q"), F.explode("ids").alias("id"), F.lit(1.0).alias("cos"))
    pool = other.union(own).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), "id"))).alias("pool"))
    member = ids.select(F.col("rep").alias("q"), F.explode("ids").alias("me"))
    # copies beyond the k+1 listed ones have the k smallest copies as neighbours
    crowded = ids.where(F.size("ids") > k).select(F.col("rep").alias("q"), F.slice("ids", 1, k).alias("first"))
    spare = valid.join(classes.where(F.size("ids") > k).select("v", F.col("rep").alias("q"), "ids"), "v").where(~F.array_contains("ids", F.col("id")))
    rest = spare.select("id", "q").join(crowded, "q").select("id", F.explode("first").alias("neighbour"), F.lit(1.0).alias("cosine"))
    listed = (
        member.join(pool, "q")
        .select(F.col("me").alias("id"), F.explode(F.slice(F.filter("pool", lambda x: x["id"] != F.col("me")), 1, k)).alias("x"))
        .select("id", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("cosine"))
    )
    return listed.union(rest)
