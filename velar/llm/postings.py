"""An inverted index over the byte positions of 64-bit fingerprints, with a count filter and a Hamming check.

A 64-bit fingerprint is read as eight positional bytes. Two fingerprints that differ in at most k bits agree in at
least 8 - k of them: that number is the guaranteed minimum. Postings of one byte would each hold a 256th of all
fingerprints, so a posting is a set of positions: the eight bytes form k + 2 blocks, of which at least two agree
unchanged, and each pair of blocks is a posting key. Every pair of fingerprints that meets in a posting is tallied
byte by byte, kept if it reaches the minimum, and verified by its Hamming distance.

A posting with more than `dense` different fingerprints (near copies by the thousand) isn't paired out. Its members
go to all points within half the distance: two fingerprints are at most k bits apart exactly if they share a point
at most ceil(k/2) and floor(k/2) bits away. A point has a bounded number of members and links them to the least one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BITS, BYTES = 64, 8


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def posting_masks(distance: int) -> list[int]:
    """Masks of the posting keys: each pair of distance + 2 blocks of whole bytes."""
    blocks = [b.tolist() for b in np.array_split(np.arange(BYTES), distance + 2)]
    masks = [sum(255 << (8 * i) for i in block) for block in blocks]
    return [_signed(x | y) for x, y in combinations(masks, 2)]


def links(prints: DataFrame, distance: int = 2, dense: int = 64) -> DataFrame:
    """(a, b): links between different fingerprints of the column fp (unique rows) that join all within distance.

    Pairs of a sparse posting are linked one by one; a dense one is linked by stars, which connect the same members.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    keys = [F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(posting_masks(distance))]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.key")
    shared = postings.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(postings.join(shared, ["slot", "key"]))  # few of all postings, and read three times
    sparse = members.where(F.col("n") <= dense)
    left = sparse.select("slot", "key", F.col("fp").alias("a"))
    right = sparse.select("slot", "key", F.col("fp").alias("b"))
    tally = sum((_byte(F.col("a"), i) == _byte(F.col("b"), i)).cast("int") for i in range(BYTES))
    pairs = (
        left.join(right, ["slot", "key"])
        .where("a < b")
        .where(tally >= BYTES - distance)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)]
    if distance == 1:  # the members themselves are the points' other half
        ball = members.where(F.col("n") > dense).select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("point"))
        own = ball.where("fp = point").select(F.col("point"))
        near = ball.join(own, "point").select(F.least("fp", "point").alias("a"), F.greatest("fp", "point").alias("b"))
        return pairs.unionByName(near.where("a < b")).distinct()
    ball = members.where(F.col("n") > dense).select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("point"))
    least = ball.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))  # at most 65 a point
    stars = least.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()
