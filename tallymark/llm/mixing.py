"""Mixing sources to target weights by capped water-filling (operator 4).

Targets: the total is shared by weight; a source stops at ``max_epochs`` times its size and
its excess goes to the others by weight until no source is above. Each round is one aggregate over
the sources, and one number, what a unit of weight gets, says all about it. Sources are ranked by sorted ranges,
so they may be as many as hosts.

Sampling: a document is repeated ``floor(target / source size)`` times and once more if it is
among the first of its source in the order of a keyed hash, up to the cut that brings the
words nearest to the target. The cut comes from a histogram of 4096 hash ranges a source;
only the one range that holds the cut is sorted, so a hot source is never one task's work.

Defined results: a null text has size 0; the null source is a source of its own, last in
order; a null id hashes as the word "null"; rows with the same id are decided alike; an
empty table, or one without words, gives targets of 0. Extra columns are carried by
``repeat`` and clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.store import SPACE, settle, temporary
from tallymark.tables import numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none. Counted from its white-space runs, without cutting it up."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    spaces = F.length(runs) - F.length(F.replace(runs, F.lit(" "), F.lit("")))
    edge = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    n = spaces + 1 - edge(runs.startswith(" ")) - edge(runs.endswith(" "))
    return F.when(F.length(runs) <= edge(runs == " "), F.lit(0)).otherwise(n).cast("long")


def hash_key(doc_id: Column, seed: str) -> Column:
    shown = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), shown)), F.lit("|"), shown)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source."""
    ranked = numbered(sizes.select("source", "source_size", F.col("source").isNull().alias("last")), ["last", "source"], "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))
    at = ranked.select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("w"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    at = settle(at, "mix-sources")
    level, full = None, -1
    while True:
        # sources that the level fills are clamped; what they leave is shared by the others
        filled = F.lit(False) if level is None else F.col("cap") < level * F.col("w")
        row = at.agg(F.sum("source_size").alias("size"), F.sum(F.when(filled, F.col("cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(filled, 0.0).otherwise(F.col("w"))).alias("rest"), F.count_if(filled).alias("full")).first()
        if row["full"] == full or not row["rest"]:
            break
        level, full = (share * row["size"] - row["taken"]) / row["rest"], row["full"]
    if row["rest"] == 0.0:  # every source is full
        level = None
    target = F.least(F.col("cap"), F.lit(level) * F.col("w")) if level is not None else F.col("cap")
    return at.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame, **knobs) -> DataFrame:
    """What each source does: (source, source_size, target, whole, cut).

    ``slim`` has source, size and key (``hash_key``). A document is taken ``whole`` times, and
    once more if ``key <= cut``.
    """
    with temporary() as keep:
        return keep(_plan(slim, **knobs))


def _plan(slim: DataFrame, **knobs) -> DataFrame:
    cells = slim.groupBy("source", F.substring("key", 1, 3).alias("cell")).agg(F.sum("size").alias("cell_size"))
    cells = settle(cells, "mix-cells")
    shares = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), **knobs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shares = shares.select("*", whole.alias("whole"))
    shares = shares.select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))
    shares = settle(shares, "mix-shares")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = cells.select("*", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)).alias("before"))
    named = shares.withColumnRenamed("source", "s")
    filled = filled.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    split = filled.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("cell_size") > F.col("need")))
    split = split.select(F.col("source").alias("s"), F.col("cell").alias("c"), "before", "need")
    inside = slim.join(split, F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, 3) == F.col("c")))
    inside = inside.groupBy("source", "before", "need", "key").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.select("*", (F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))).alias("start"))
    edge = inside.where(2 * F.col("start") + F.col("size") <= 2 * F.col("need"))
    exact = edge.groupBy("source").agg(F.max("key").alias("cut"))
    # all of the ranges that end before the need are taken; "~" sorts after every hash digit
    done = filled.where((F.col("before") + F.col("cell_size") <= F.col("need")) & (F.col("need") > 0))
    done = done.groupBy("source").agg(F.concat(F.max("cell"), F.lit("~")).alias("cut"))
    cuts = exact.unionByName(done).groupBy("source").agg(F.max("cut").alias("cut")).withColumnRenamed("source", "s")
    out = shares.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return settle(out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")), "mix-plan")


def decide(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (with source and key) and their ``copies``, source_size and target."""
    named = sources.withColumnRenamed("source", "mix_source")
    if sources.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    return joined.withColumn("copies", F.col("whole") + F.when(F.col("key") <= F.col("cut"), F.lit(1)).otherwise(F.lit(0)))


def slim_rows(docs: DataFrame, seed: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), hash_key(F.col(id_col), seed).alias("key"),
    )


def mix(docs: DataFrame, seed: str = "mix", **knobs) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies."""
    slim = settle(slim_rows(docs, seed), "mix-sizes")
    out = decide(slim, plan(slim, **knobs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat(docs: DataFrame, seed: str = "mix", copy_col: str | None = None, **knobs) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns, and its copies' numbers from 1 in ``copy_col``."""
    with temporary() as keep:
        slim = settle(slim_rows(docs, seed), "mix-sizes")
        sources = keep(plan(slim, **knobs))
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("row"), F.col("source").alias("source"), hash_key(F.col("doc_id"), seed).alias("key")
    )
    out = decide(packed, sources).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    kept = [F.col("row")[c].alias(c) for c in names if c != copy_col]
    return out.select(*kept, *([F.col("copy").alias(copy_col)] if copy_col else []))
