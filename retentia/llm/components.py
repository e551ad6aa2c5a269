"""Connected components of a link table, in rounds of contraction.

Every vertex has a fixed random rank (a hash of its id).  In a round each vertex moves to the lowest-ranked one
among itself and its neighbours, and the links move along; links inside a vertex go.  Random ranks make the number
of vertices fall by a constant factor a round in expectation, for paths as for stars.  Then the moves are followed
back from the last round to the first.  A hub's links are reduced by partial aggregation before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link to another; the component is its smallest id.

    Links may repeat and may stand in either direction; nulls and links of an id to itself are left out.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    moves: list[DataFrame] = []
    while True:
        both = links.union(links.select("b", "a"))
        ranked = lambda c: F.struct(F.xxhash64(c), F.col(c))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("rank"), F.col("b").alias("id"))).alias("best"))
        moves.append(cut_lineage(best.select(F.col("a").alias("id"), F.when(F.col("best") < ranked("a"), F.col("best.id")).otherwise(F.col("a")).alias("to"))))
        to_a, to_b = (moves[-1].select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        links = cut_lineage(links.join(to_a, "a").join(to_b, "b").filter("to_a <> to_b")
                            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if links.isEmpty():
            break
    roots = moves[-1]
    for earlier in reversed(moves[:-1]):
        later = roots.select(F.col("id").alias("to"), F.col("to").alias("root"))
        roots = earlier.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    smallest = roots.groupBy("to").agg(F.min("id").alias("component"))
    return roots.join(smallest, "to").select("id", "component")
