"""Problem 8: evaluation passages inside the corpus, by greedy string tiling.

Texts are compared word by word.  Seeds of ``SEED_WORDS`` shared words between a document and an item are found with
Karp-Rabin hashes; a pair is worth tiling only if its seeds, laid over the item, could hold a run of ``RUN_WORDS`` words or
cover ``COVERAGE`` of the item.  Tiling (``tiling.py``) then marks the longest non-overlapping matches again and again (the
first one is the longest common run, the sum of all catches passages whose parts were reordered).

The items are a held-out test set of bounded size: up to ``BROADCAST_WORDS`` words they are broadcast.  A larger set meets
the documents' seeds in a shuffle, in which phrases that very many texts hold are dealt to several tasks; the same test on
the seeds of a pair decides which items are sent to a document, in rows of at most ``ITEMS_A_ROW`` items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tiling import tiles
from tessera.plans.cluster import cut

WORD = re.compile(r"[^\W_]+")
SEED_WORDS, RUN_WORDS, COVERAGE, BROADCAST_WORDS = 5, 12, 0.8, 2_000_000
HOT_SEEDS, PARTS, ITEMS_A_ROW = 10_000, 32, 64
BASE = np.uint64(1099511628211)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` word numbers (modulo 2^64)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * BASE + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    return h


class Items:
    """The test items as word numbers, with the sorted hashes of their seeds and where these lie."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids = [i for i, _ in rows]
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in words(t)], np.int64) for _, t in rows]
        hashes, owner, place = [], [], []
        for k, w in enumerate(self.words):
            h = rolling(w, SEED_WORDS)
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int64))
            place.append(np.arange(len(h), dtype=np.int64))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner, self.place = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (owner, place))
        self.longest = max([len(w) for w in self.words], default=0) + 1

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item id, longest run, words covered, share of the item covered) of every item that leaks into ``text``."""
        doc = np.array([self.number.get(w, -1) for w in words(text)], np.int64)
        if len(doc) < SEED_WORDS or not len(self.hash):
            return []
        known = doc >= 0
        whole = np.convolve(known, np.ones(SEED_WORDS, np.int64), "valid") == SEED_WORDS
        starts = np.nonzero(whole)[0]
        if not len(starts):
            return []
        h = np.unique(rolling(doc, SEED_WORDS)[starts])
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        if not n.any():
            return []
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.unique(self.owner[at] * self.longest + self.place[at])
        owner, place = key // self.longest, key % self.longest
        # words a seed adds to what the seeds before it cover, and lengths of unbroken seed rows
        same = np.concatenate([[False], owner[1:] == owner[:-1]])
        gap = np.concatenate([[0], np.diff(place)])
        fresh = np.where(same & (gap < SEED_WORDS), gap, SEED_WORDS)
        cover = np.bincount(owner, fresh, len(self.ids))
        row = np.cumsum(~(same & (gap == 1))) - 1
        unbroken = np.zeros(len(self.ids), np.int64)
        np.maximum.at(unbroken, owner, np.bincount(row)[row] + SEED_WORDS - 1)
        out = []
        for k in np.nonzero((unbroken >= RUN_WORDS) | ((cover > 0) & (cover >= COVERAGE * np.array([max(1, len(w)) for w in self.words]))))[0]:
            found = tiles(doc, self.words[k], SEED_WORDS)
            run, covered = max([t[2] for t in found], default=0), sum(t[2] for t in found)
            share = covered / len(self.words[k])
            if run >= RUN_WORDS or share >= COVERAGE:
                out.append((self.ids[k], run, covered, share))
        return out


_built: list[tuple[object, Items]] = []


def _held(shared) -> Items:
    """The items of a broadcast, built once in a worker process."""
    rows = shared.value  # the same list as long as the broadcast lives in this process
    if not _built or _built[0][0] is not rows:
        _built[:] = [(rows, Items(rows))]
    return _built[0][1]


def seeds(df: DataFrame) -> DataFrame:
    """(id, place, h): every seed of the texts (id, text) and where it begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"]):
                w = words(t)
                h = np.array([xxhash.xxh64_intdigest(" ".join(w[j : j + SEED_WORDS])) - (1 << 63) for j in range(len(w) - SEED_WORDS + 1)], np.int64)
                yield pd.DataFrame({"id": i, "place": np.arange(len(h)), "h": h})

    return df.mapInPandas(run, "id long, place long, h long")


def seeded_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item): documents and items whose shared seeds could hold a run of ``RUN_WORDS`` words or cover ``COVERAGE`` of the item.

    A run of n words has n - 4 seeds; tiles of five words at least cover as much as five times their seeds.  So an item of
    which fewer places are met than either needs is left out; that loses no leak.  A phrase of more than ``HOT_SEEDS``
    documents is dealt to ``PARTS`` tasks by the document, and its places in the items are repeated for each of them.
    """
    of_item = cut(seeds(items).select(F.col("id").alias("item"), "place", "h"))
    known = of_item.select("h").distinct()
    of_doc = cut(seeds(docs).select("id", "h").distinct().join(known, "h", "left_semi"))
    hot = of_doc.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEEDS).select("h", F.lit(PARTS).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = of_doc.join(hot, "h", "left").select("id", "h", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    right = of_item.join(hot, "h", "left").select("item", "place", "h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = left.join(right, ["h", "part"]).groupBy("id", "item").agg(F.count_distinct("place").alias("met"))
    length = of_item.groupBy("item").agg((F.max("place") + SEED_WORDS).alias("length"))
    least = F.least(F.lit(RUN_WORDS - SEED_WORDS + 1), F.ceil(F.col("length") * COVERAGE / SEED_WORDS - 1e-9))
    return met.join(length, "item").where(F.col("met") >= least).select("id", "item")


def leaked(docs: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, longest_run, covered_words, coverage) of every document and item that leaked into it.

    ``docs`` and ``items`` have (id, text).  Null and empty texts and items below ``SEED_WORDS`` words match nothing; equal
    items and documents are reported each.
    """
    docs, items = docs.where("id is not null and text is not null"), items.where("id is not null and text is not null")
    schema = "doc_id long, item_id long, longest_run long, covered_words long, coverage double"
    names = ["doc_id", "item_id", "longest_run", "covered_words", "coverage"]
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size <= broadcast_words * 6:  # about six characters a word
        held = docs.sparkSession.sparkContext.broadcast([(r["id"], r["text"]) for r in items.orderBy("id").collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _held(held)
            for pdf in batches:
                yield pd.DataFrame([(i, *x) for i, t in zip(pdf["id"], pdf["text"]) for x in known.leaks(t)], columns=names)

        return docs.select("id", "text").mapInPandas(run, schema)

    pairs = cut(seeded_pairs(docs.select("id", "text"), items.select("id", "text")))
    sent = pairs.join(items.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
    share = F.ceil(F.col("n") / ITEMS_A_ROW)
    count = pairs.groupBy("id").agg(F.count("*").alias("n"))
    packed = sent.join(count, "id").groupBy("id", F.pmod(F.xxhash64("item"), share).alias("row")).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *x) for i, t, ks in zip(pdf["id"], pdf["text"], pdf["items"]) for x in Items([(k["item"], k["item_text"]) for k in ks]).leaks(t)], columns=names)

    return packed.join(docs.select("id", "text"), "id").select("id", "text", "items").mapInPandas(some, schema)
