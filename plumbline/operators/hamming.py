"""Exact nearest words by differing bits, through an index of their bands.

A 64-bit word has four bands of 16 bits. If two words differ in d bits, some band of
theirs differs in d // 4 or fewer. Rounds of growing radius ask for all values of a
band that differ in so many bits; after round r every row that differs in fewer than
4 (r + 1) bits has been met, so a query whose k-th best is among those is answered and
leaves. What rounds would cost more than meeting all rows is left to blocks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as C
from ..session import kept
from .matching import nearest_bits, top_k

BANDS, WIDTH = 4, 16
#: Rounds of the index; a round r asks for C(16, r) values of each band.
ROUNDS = 5


def bands(rows: DataFrame) -> DataFrame:
    """(band, value, vec_id, word): a row for each band of each word."""
    value = lambda b: F.shiftrightunsigned("word", WIDTH * b).bitwiseAND((1 << WIDTH) - 1).cast("int")
    return rows.select(F.posexplode(F.array(*(value(b) for b in range(BANDS)))).alias("band", "value"), "vec_id", "word")


def masks(radius: int) -> list[int]:
    """All band values of so many bits."""
    return [sum(1 << b for b in chosen) for chosen in combinations(range(WIDTH), radius)]


def nearest_by_bands(queries: DataFrame, rows: DataFrame, k: int, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, int]]:
    """((query, candidate, bits, rank), rows compared by round): for each query the k other rows that differ in the fewest bits, then by id.

    Both sides have (vec_id, word), ids once. The result is that of nearest_bits; the
    counts tell how many (query, row) pairs each round has met, and how many queries
    were left for blocks. Without rows or queries there is no result.
    """
    index = kept(bands(rows), "bands")
    left = kept(queries.select("vec_id", "word"), "queries")
    best, done, counts = None, [], {}
    for radius in range(rounds):
        if not left.limit(1).count():
            break
        asked = bands(left).select(F.col("band"), F.explode(F.transform(F.lit(masks(radius)), lambda m: F.col("value").bitwiseXOR(m))).alias("value"), F.col("vec_id").alias("query"), F.col("word").alias("_word"))
        met = asked.join(index, ["band", "value"]).where("vec_id <> query")
        fresh = met.select("query", F.col("vec_id").alias("candidate"), C.hamming(F.col("_word"), F.col("word")).cast("int").alias("bits"))
        every = fresh.distinct() if best is None else fresh.unionByName(best.join(left.select(F.col("vec_id").alias("query")), "query", "left_semi").drop("rank")).distinct()
        every = kept(every, "met")
        counts[f"round {radius}"] = every.count()
        best = kept(top_k(every, "query", [F.col("bits"), F.col("candidate")], k), "best")
        # The k-th best is certain where all rows with as many bits have been met.
        certain = best.where((F.col("rank") == k) & (F.col("bits") < BANDS * (radius + 1))).select("query")
        done.append(best.join(certain, "query", "left_semi"))
        left = kept(left.join(certain, left["vec_id"] == certain["query"], "left_anti"), "queries")
    counts["left"] = left.count()
    out = nearest_bits(left, rows, k)
    for part in done:
        out = out.unionByName(part.select(*out.columns))
    return out, counts
