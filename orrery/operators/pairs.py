"""Training pairs: weighted positives, hard negatives from retrieval, hash-drawn random negatives."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scoring import sample_weight
from orrery.operators.retrieval import ranked
from orrery.operators.truth import ClassTruth, Truth, counts, outside


def positives(truth: Truth, splits: tuple[str, ...] = ("train", "validation"), parts: tuple[float, float, float] = (0.7, 0.3, 0.1)) -> Truth:
    """The truth of these splits with sample_weight; for classes, by their grades and not pair by pair."""
    if isinstance(truth, ClassTruth):
        return truth.graded(lambda g: positives(g, splits, parts))
    return truth.where(F.col("split").isin(*splits)).withColumn("sample_weight", sample_weight(F.col("relevance_score"), F.col("proficiency"), parts))


def hard_negatives(predictions: DataFrame, truth: Truth, count: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """The first ``count`` retrieved items that aren't truth, with their rank in the retrieval."""
    missed = outside(predictions, truth, query, item).withColumnsRenamed({"rank": "retrieval_rank", "score": "retrieval_score"})
    return ranked(missed, [query], count, F.col("retrieval_rank")).drop("rank").withColumn("negative_type", F.lit("hard_retrieval"))


def prime_from(n: int) -> int:
    """The least prime that is n or more."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def scattered(seed: str, key: Column, step: Column, prime: int) -> Column:
    """Place number ``step`` of the key's own permutation of 0..prime - 1: a line modulo the prime, with a slope and a start
    drawn from the key's digest."""
    draw = lambda name, most: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(most))
    return F.pmod((draw("slope", prime - 1) + 1) * step + draw("start", prime), F.lit(prime))


#: Draws of a first round for each item that is asked for, and how many times as many the next round has.
DRAWS, MORE = 4, 4


def random_negatives(queries: DataFrame, items: DataFrame, taken: Truth | tuple[Truth, ...], count: int, seed: str, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """``count`` distinct items a query that no ``taken`` has; the same on any cluster. Raises if a catalog leaves fewer.

    Items are numbered in the order of their keys. A query draws numbers by a permutation of its own and keeps the first free
    ones. All queries draw a few; those for which these don't do draw again, more each round, at most the whole catalog. So
    the work follows what is asked for, and what is taken only where little is free. Each round is one action."""
    from orrery.sources.tables import numbered

    items, takers = items.select(item).distinct(), taken if isinstance(taken, tuple) else (taken,)
    prime, numbers = prime_from(items.count()), numbered(items, item, "_no")
    left, upto, found = queries.select(query).distinct(), max(2, DRAWS * count), []
    while True:
        upto = min(upto, prime)
        drawn = left.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(upto - 1).cast("long")))).withColumn("_no", scattered(seed, F.col(query), F.col("_o"), prime))
        free = drawn.join(numbers, "_no")
        for t in takers:
            free = outside(free, t, query, item)
        free = ranked(free, [query], count, F.col("_o")).select(query, item, F.lit("random").alias("negative_type")).persist()
        done = free.groupBy(query).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == count).select(query)
        found.append(free.join(done, query, "left_semi"))
        left = left.join(done, query, "left_anti")
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        if upto == prime:
            raise ValueError("the catalog leaves too few items to draw")
        upto *= MORE


def pair_counts(index: DataFrame, positive: Truth, negative: Truth, query: str = "query_id") -> DataFrame:
    count = lambda f, name: counts(f, query).withColumnRenamed("_n", name)
    out = index.join(count(positive, "positive_count"), query, "left").join(count(negative, "negative_count"), query, "left")
    return out.fillna(0, ["positive_count", "negative_count"])
