"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into a fixed number of blocks.  A matrix says how many rows each block sends to each
shard; drawn row by row from the multivariate hypergeometric law, it is distributed as under a
uniform permutation of all rows.  Each block permutes its rows and deals them out by its row of
the matrix; each shard permutes what it receives.  The driver sees one count per block.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Blocks, and parts in which a shard's rows are put in order: both fixed, so that the driver's
#: tables are too.
BLOCKS = 4096
PARTS = 1024


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn from good + bad are good."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    # Beyond numpy's range: inversion from the mode outwards.
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    ways = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(ways(good, mode) + ways(bad, n - mode) - ways(good + bad, n))
    u, down, up, at_down, at_up = rng.random() - p, p, p, mode, mode
    while u > 0 and (at_down > low or at_up < high):
        if at_up < high:
            up *= (good - at_up) * (n - at_up) / ((at_up + 1) * (bad - n + at_up + 1))
            at_up += 1
            u -= up
            if u <= 0:
                return at_up
        if at_down > low:
            down *= at_down * (bad - n + at_down) / ((good - at_down + 1) * (n - at_down + 1))
            at_down -= 1
            u -= down
            if u <= 0:
                return at_down
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts with the row sums ``rows`` and column sums at most one apart."""
    total = sum(rows)
    rng = np.random.default_rng(seed)
    spare = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = []
    for need in rows:
        line, rest = [], sum(spare)
        for k in range(shards):
            rest -= spare[k]
            got = min(need, spare[k]) if not rest else _draw(rng, spare[k], rest, need)
            line.append(got)
            need -= got
            spare[k] -= got
        matrix.append(line)
    return matrix


def shuffle_into_shards(rows: DataFrame, key: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (0 to shards - 1, whose row counts differ by one at most) and ``slot`` (gapless
    from 0 in each shard) to every row.

    ``key`` names the columns that tell rows apart; rows equal in all of them, nulls included,
    are told apart by their place in the input.  The draw is written before it is counted, so
    that a task that runs again deals the same rows.  Columns may have any names but ones with a leading ``_sh_``.
    An empty table gives no rows.
    """
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()
    drawn = rows.withColumn("_sh_key", F.xxhash64(F.lit(seed), *key, place))
    drawn = drawn.withColumn("_sh_block", F.pmod(F.xxhash64(F.lit("block"), "_sh_key"), F.lit(BLOCKS)).cast("int"))
    drawn = materialise(drawn, "drawn")
    counted = {r[0]: r[1] for r in drawn.groupBy("_sh_block").agg(F.count("*")).collect()}  # BLOCKS numbers at most
    blocks = sorted(counted)
    matrix = communication_matrix([counted[b] for b in blocks], shards, seed)
    upto = [np.cumsum(line).tolist() for line in matrix]
    # One row a block and one number a shard.
    text = json.dumps([{"b": b, "c": c} for b, c in zip(blocks, upto, strict=True)])
    sent = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<b: int, c: array<long>>>")).alias("m")).select(F.col("m.b").alias("_sh_block"), F.col("m.c").alias("_sh_upto"))
    local = Window.partitionBy("_sh_block").orderBy("_sh_key", *key)
    dealt = drawn.withColumn("_sh_rank", F.row_number().over(local)).join(F.broadcast(sent), "_sh_block")
    dealt = dealt.withColumn("shard", F.size(F.filter("_sh_upto", lambda c: c < F.col("_sh_rank"))))
    dealt = dealt.withColumn("_sh_order", F.xxhash64(F.lit("slot"), F.lit(seed), "_sh_key", "shard"))
    dealt = dealt.withColumn("_sh_part", F.shiftrightunsigned(F.col("_sh_order"), 64 - int(math.log2(PARTS))).cast("int"))
    dealt = materialise(dealt.drop("_sh_upto", "_sh_rank", "_sh_block"), "shards")
    sizes = dealt.groupBy("shard", "_sh_part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("_sh_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("shard", "_sh_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_sh_before"))
    own = Window.partitionBy("shard", "_sh_part").orderBy("_sh_order", "_sh_key", *key)
    placed = dealt.withColumn("_sh_own", F.row_number().over(own) - 1).join(F.broadcast(before), ["shard", "_sh_part"])  # shards * PARTS rows at most
    return placed.withColumn("slot", (F.col("_sh_own") + F.col("_sh_before")).cast("long")).select(*rows.columns, "shard", "slot")


def sharded(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of
    ``docs`` (doc_id, text); size is the text's UTF-8 bytes, none for null, plus 8.

    The law is ``rows``: shards' row counts differ by one at most, whatever the sizes of the texts,
    so ``grown_shard`` is null.  Null and empty texts and null ids are dealt as all rows are; equal
    texts and repeated rows are told apart by their place in the input, so that the same rows in
    other files are dealt otherwise.  Other columns are not read; an empty table gives no rows.
    """
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shuffle_into_shards(digest, ["doc_id", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
