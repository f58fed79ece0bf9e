"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine a temporary folder if none is named, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallymark/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts lineage, and what is used twice is computed once.

    A lost executor costs the tasks it ran, not the plan above the table.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


@contextlib.contextmanager
def temporary() -> Iterator[Callable[..., DataFrame]]:
    """Removes the tables settled inside when left, but for those that the result needs.

    ``keep(result, *tables)`` names these, settled tables that ``result`` reads, and gives the result back.
    """
    outer, inner, kept = _written.get(), [], set()
    token = _written.set(inner)

    def keep(result: DataFrame, *tables: DataFrame) -> DataFrame:
        kept.update(t._settled for t in (result, *tables) if hasattr(t, "_settled"))
        return result

    try:
        yield keep
    finally:
        _written.reset(token)
        for spark, path in inner:
            if path in kept:
                if outer is not None:
                    outer.append((spark, path))
            else:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A key with more rows than this is hot; with more than ``FEW`` such keys the bound rises, so that never more are broadcast.
HOT, FEW = 1 << 16, 20_000


def spread_join(many: DataFrame, one: DataFrame, on: list[str], hot: int = HOT, counted: str | None = None) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row for each key, without a task that holds all rows of a hot key.

    The rows of ``one`` for hot keys are broadcast: there are at most ``FEW`` of them, since a key is hot only if it has
    more than a ``FEW``-th of all rows. ``many`` should be a written table, for it is counted first, unless ``one``, then
    a written table, has the number of its rows for each key in the column ``counted``. Null keys meet nothing.
    """
    counts = many.groupBy(*on).agg(F.count("*").alias("__n")) if counted is None else one.select(*on, F.col(counted).alias("__n"))
    one = one if counted is None else one.drop(counted)
    sizes = counts.agg(F.max("__n").alias("most"), F.sum("__n").alias("all")).first()
    bound = max(hot, -(-(sizes["all"] or 0) // FEW))
    if (sizes["most"] or 0) <= bound:
        return many.join(one, on)
    few = settle(counts.where(F.col("__n") > bound).select(*on), "hot-keys")
    heavy = many.join(F.broadcast(few), on, "left_semi").join(F.broadcast(one.join(F.broadcast(few), on, "left_semi")), on)
    return heavy.unionByName(many.join(F.broadcast(few), on, "left_anti").join(one, on))


#: Keys, at most, that are broadcast as they are. Of more, bits are: so many for each, in all, and in a row.
MANY, BITS, MOST_BITS, ROW = 400_000, 16, 1 << 28, 4096


def of_keys(many: DataFrame, keys: DataFrame, on: str, n: int) -> DataFrame:
    """The rows of ``many`` whose key is one of the ``n`` distinct ``keys``, of which no more are shuffled than that and few others.

    Few keys are broadcast. Of many a bit for each hash is, 16 MB for five million, which lets about a sixteenth of the other keys
    through; the rows that are left meet the keys themselves, held as a table of hashes in each task, so that they are not sorted.
    """
    if n <= MANY:
        return many.join(F.broadcast(keys), on, "left_semi")
    bits = min(1 << (BITS * n - 1).bit_length(), MOST_BITS)
    bit = F.pmod(F.xxhash64(on), F.lit(bits))
    place = {"row": F.floor(bit / ROW).cast("int"), "word": F.floor(F.pmod(bit, F.lit(ROW)) / 64).cast("int"), "at": F.pmod(bit, F.lit(64)).cast("int")}
    words = keys.where(F.col(on).isNotNull()).select(*[c.alias(name) for name, c in place.items()]).groupBy("row", "word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    rows = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("of"))
    zero = F.lit(0).cast("bigint")
    rows = settle(rows.select(F.col("row").alias("__row"), F.transform(F.sequence(F.lit(0), F.lit(ROW // 64 - 1)), lambda w: F.coalesce(F.try_element_at("of", w), zero)).alias("__words")), "key-bits")
    near = many.withColumn("__row", place["row"]).join(F.broadcast(rows), "__row")  # MOST_BITS / ROW rows at most, 512 bytes each
    near = near.where(F.getbit(F.get("__words", place["word"]), place["at"]) == 1).drop("__row", "__words")
    # an inner join: Spark would put a semi join before that with the bits
    return near.join(keys.hint("shuffle_hash"), on)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once a row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over all cores, four parts each at least: for small rows that much work follows, however few files or row groups they come from."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its global rank from 1, without a global window: sorted ranges, numbered inside, with offsets.

    The ranges are written first, so that counting and numbering see the same ones.
    """
    ranges = settle(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    # a row for each range: as many as spark.sql.shuffle.partitions
    offsets = F.broadcast(counts.select("part", before.alias("before")))
    return ranges.join(offsets, "part").withColumn(name, (F.col("before") + inside).cast("bigint")).drop("part", "before")
