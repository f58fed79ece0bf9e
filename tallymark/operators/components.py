"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.tables import HOT, settle, spread_join, temporary


def _starry(stars: DataFrame) -> bool:
    """Whether each larger node hangs on one smaller node, which itself hangs on none: what neither turn changes."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(stars.select("b", F.lit(0), F.lit(1)))
    told = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not told.where("hangs > 1 or hangs = 1 and holds = 1").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b", hot: int = HOT) -> DataFrame:
    """(node, root): the smallest node that each is connected with.

    Large stars and small stars take turns: each node hands its larger neighbours to the smallest of its
    neighbours and itself, then its smaller ones with itself to the smallest of them, until the edges are stars around roots, as they
    may be from the start. The
    number of edges never grows, rounds grow with the logarithm of the longest path, and the edges of each round are a table.
    The smallest neighbour comes from an aggregate that combines before it shuffles, and goes back to the edges by ``spread_join``,
    so that a hub of any size is the work of many tasks. Loops and repeated edges change nothing.
    """
    with temporary() as keep:
        x, y = F.col(a), F.col(b)
        stars = settle(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
        while not _starry(stars):
            for turn in ("large", "small"):
                if turn == "large":
                    both = settle(stars.select("a", "b").union(stars.select(F.col("b"), F.col("a"))), "both")
                    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
                    moved = spread_join(both.where("b > a"), settle(least, "least"), ["a"], hot).select(F.col("b").alias("a"), F.col("m").alias("b"))
                else:
                    least = settle(stars.groupBy("a").agg(F.min("b").alias("m")), "least")
                    own = spread_join(stars, least, ["a"], hot).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    moved = own.union(least.select("a", F.col("m").alias("b")))
                stars = settle(moved.distinct(), "stars")
        found = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return keep(settle(found.union(stars.select("b", "b").distinct()), "components"))
