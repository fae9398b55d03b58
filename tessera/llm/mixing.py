"""Problem 9: mixing sources to target weights.

Slots of equal token size are dealt to the sources by a low-discrepancy sequence: slot i falls at the i-th golden-ratio
point of the unit interval, and the cumulative weights tell whose slot it is, so every stretch of slots holds every source
in proportion.  The r-th slot of a source takes its block r modulo the number of its blocks.  Blocks are runs of shuffled
documents: the token line of a source is cut at every multiple of the block, and a document belongs to the block in which it
begins; one that is longer than a block is first cut into pieces of a block, so that no block is empty.  A source whose
slots exceed its blocks times its cap leaves the rest empty, and the shares actually reached are reported.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import running_sum
from tessera.plans.cluster import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS, BUCKETS, SLOT_CHUNK = 4096, 128, 65_536
GOLDEN = 1_327_217_885  # 2^31 over the golden ratio, odd, so that all 2^31 points differ
MOST_SOURCES = 10_000  # of the stated target list


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[Column], path: str = TOKENIZER) -> DataFrame:
    """(id, kept columns, tokens): tokens of each whole text by a public tokenizer; null counts as nothing."""
    spare = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def size(t: str | None) -> int:
            if not t:
                return 0
            return len(coder.encode_ordinary(t.encode("utf-8", "replace").decode("utf-8")))

        for pdf in batches:
            pdf["tokens"] = [size(t) for t in pdf["text"]]
            yield pdf.drop(columns="text")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spare.drop("text").schema)
    return spare.mapInPandas(run, f"{kinds}, tokens long")


def source_key(c: str) -> Column:
    """Sources compare trimmed and lower-cased; a blank one is none."""
    k = F.lower(F.trim(F.col(c)))
    return F.when(k != "", k)


def sized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of the documents with a source, written once."""
    return cut(token_counts(docs.where(source_key("source").isNotNull()), "doc_id", "text", [source_key("source").alias("source")], path))


def budget(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: own tokens, tokens wanted of all, the most it can give, and whether that is too little.

    ``targets`` (source, target_bp, max_repeats): a source without documents has size 0; repeated targets are all kept.
    """
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count("*").alias("documents"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    t = targets.select(source_key("source").alias("source"), F.col("target_bp").cast("long").alias("target_bp"), F.col("max_repeats").cast("long").alias("max_repeats")).where("source is not null")
    out = t.join(own, "source", "left").withColumn("all_tokens", F.lit(total).cast("long"))
    out = out.withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    return out.withColumn("short", F.col("own_tokens") * F.col("max_repeats") * 10000 < F.col("target_bp") * F.col("all_tokens"))


def blocks(sizes: DataFrame, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block, id, piece, tokens): documents shuffled by hash and cut into blocks of about ``block_tokens``."""
    whole = sizes.where(F.col("tokens") <= block_tokens).withColumn("piece", F.lit(0))
    long = sizes.where(F.col("tokens") > block_tokens).withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / block_tokens).cast("int") - 1)))
    long = long.withColumn("tokens", F.least(F.lit(block_tokens).cast("long"), F.col("tokens") - F.col("piece") * block_tokens))
    keyed = whole.unionByName(long).withColumn("key", F.xxhash64(F.lit(seed), "id", "piece")).withColumn("tie", F.struct("id", "piece"))
    return running_sum(keyed, ["source"], "key", "tie", "tokens", BUCKETS).select("source", F.floor(F.col("before") / block_tokens).alias("block"), "id", "piece", "tokens")


def schedule(weights: list[tuple[str, int]], slots: DataFrame) -> DataFrame:
    """(slot, source, turn): the source of each slot and how many slots of that source come before it."""
    whole = sum(w for _, w in weights)
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * GOLDEN, F.lit(1 << 31))
    # the slot belongs to the source in whose stretch of the cumulative weights its point falls
    upto, marks = 0, []
    for _, w in weights:
        upto += w
        marks.append(-(-upto * (1 << 31) // whole))  # the first point beyond the stretch
    ends, names = F.array(*map(F.lit, marks[:-1])).cast("array<bigint>"), F.array(*[F.lit(name) for name, _ in weights])
    dealt = slots.select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"))
    dealt = dealt.select("slot", "chunk", F.element_at(names, F.size(F.filter(ends, lambda m: m <= F.col("point"))) + 1).alias("source"))
    tally = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = tally.select("source", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    local = dealt.withColumn("k", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    return local.join(before, ["source", "chunk"]).select("slot", "source", (F.col("off") + F.col("k")).alias("turn"))


def _wanted(sizes: DataFrame, targets: DataFrame) -> list:
    """The stated targets with a share, one row a source, and the size of all documents."""
    wanted = budget(sizes, targets).groupBy("source").agg(F.sum("target_bp").alias("bp"), F.max("max_repeats").alias("most"), F.max("all_tokens").alias("all")).where("bp > 0").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    return wanted


def mixture(sizes: DataFrame, targets: DataFrame, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, repeat, block, id, piece, tokens): the documents of every filled slot; repeat counts the uses of a block from 1.

    ``sizes`` is written (see ``sized``).  The mixture is as large as the corpus with a source; no documents give no rows.
    A document of more than a block comes in pieces of ``block_tokens`` tokens, numbered from 0.
    """
    spark, wanted = sizes.sparkSession, _wanted(sizes, targets)
    if not wanted:
        return spark.createDataFrame([], "slot long, source string, repeat long, block long, id long, piece int, tokens long")
    slots = spark.range(0, -(-(wanted[0]["all"] or 0) // block_tokens))
    held = cut(blocks(sizes, seed, block_tokens))
    count = held.groupBy("source").agg((F.max("block") + 1).alias("blocks"))
    caps = spark.createDataFrame([(r["source"], int(r["most"] or 0)) for r in wanted], "source string, most long")
    dealt = schedule([(r["source"], int(r["bp"])) for r in wanted], slots).join(count.join(caps, "source"), "source").where(F.col("turn") < F.col("blocks") * F.col("most"))
    used = dealt.select("slot", "source", (F.floor(F.col("turn") / F.col("blocks")) + 1).alias("repeat"), F.pmod("turn", "blocks").alias("block"))
    return used.join(held, ["source", "block"]).select("slot", "source", "repeat", "block", "id", "piece", "tokens")


def unmet(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source): sources that the schedule deals more slots than they can fill under their cap, checked by their tokens.

    The golden-ratio points give a source its share of the slots to within ``slack`` slots (the discrepancy of n points is
    below 3 + log2 n), so whoever is short by tokens is dealt at least its capacity less the slack; of these the exact
    comparison of tokens keeps the short ones.  Without documents no source is short.
    """
    spark, wanted = sizes.sparkSession, _wanted(sizes, targets)
    if not wanted or not wanted[0]["all"]:
        return spark.createDataFrame([], "source string")
    n = -(-wanted[0]["all"] // block_tokens)
    slack = 4 + n.bit_length()
    turns = schedule([(r["source"], int(r["bp"])) for r in wanted], spark.range(0, n)).groupBy("source").agg((F.max("turn") + 1).alias("dealt"))
    room = F.col("own_tokens") * F.col("max_repeats") / block_tokens
    judged = budget(sizes, targets).join(turns, "source", "left").where(F.coalesce("dealt", F.lit(0)) >= room - slack)
    return judged.where("short").select("source")


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source its target share, tokens and share in the mixture, most repeats used, and whether it falls short."""
    got = cut(mixture(sizes, targets).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max("repeat").alias("repeats")))
    total = got.agg(F.sum("mixed_tokens")).first()[0]
    b = budget(sizes, targets).join(got, "source", "left").withColumn("t", F.lit(total).cast("long"))
    return b.select(
        "source", "target_bp", "max_repeats", "own_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
        F.round(F.coalesce(F.col("mixed_tokens") / F.col("t"), F.lit(0.0)), 6).alias("reached_share"), F.round(F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share_of_budget"), "short",
    )
