"""Sharding by a keyed Feistel permutation of global row numbers (operator 5, native).

Rows get gapless global numbers in a reproducible order: by a hash cell of all that is numbered (id,
size and checksum), then by these inside the cell. Equal rows are counted first, in ``SALTS`` portions,
and the counts are numbered: by a window over their cell, with offsets of cells from a histogram
of 4096 cells. So no task sees more than a cell of distinct rows, however many are equal. A
Feistel network over a rectangle ``a x b >= n`` permutes the numbers; cycle walking takes the
few places beyond n back into range. Shard and slot are then arithmetic, and
``locate`` / ``row_at`` compute them either way without any table.

Law: ``rows`` - shards differ by one row at most. ``grown_shard`` is null, as moving to more
shards is not this law's promise.

Defined results: a null text counts as an empty one (size 16, checksum 0); a null id comes
first in its cell; repeated rows get numbers of their own, and as equal rows are
interchangeable the table of results is still reproducible. An empty table gives an empty one.
Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.store import settle

ROUNDS = 6
#: Prime modulus of the round function; squares of its residues fit 64 bits.
P = 2_147_483_647
#: Steps of cycle walking that the plan unrolls; a walk longer than that raises an error.
WALK = 64
#: Portions in which equal rows are counted and numbered.
#: Equal rows that are told out at once.
STEP = 1 << 16
SALTS = 64


def _keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an offset for each round, from a linear congruence started at ``seed``."""
    x, out = seed % P, []
    for _ in range(ROUNDS):
        a = x = (x * 48_271 + 11) % P
        b = x = (x * 48_271 + 11) % P
        out.append((a or 1, b))
    return out


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: int = 1) -> int:
    """Place of row ``x`` of ``n``; what ``permuted`` computes in the plan."""
    a, b = sides(n)
    while True:
        left, right = x % a, x // a
        for i, (k, c) in enumerate(_keys(seed)):
            if i % 2 == 0:
                left = (left + _mix(right, k, c)) % a
            else:
                right = (right + _mix(left, k, c)) % b
        x = left + a * right
        if x < n:
            return x


def unpermute(y: int, n: int, seed: int = 1) -> int:
    a, b = sides(n)
    while True:
        left, right = y % a, y // a
        for i, (k, c) in reversed(list(enumerate(_keys(seed)))):
            if i % 2 == 0:
                left = (left - _mix(right, k, c)) % a
            else:
                right = (right - _mix(left, k, c)) % b
        y = left + a * right
        if y < n:
            return y


def _mix(x, k: int, c: int):
    """Round function, alike for Python integers and for Columns (all values stay below 2**62)."""
    f = (x * k + c) % P
    return (f * f + k) % P % 1_000_003 * 1_009 + f % 1_009


def locate(row: int, n: int, shards: int, seed: int = 1) -> tuple[int, int]:
    place = permute(row, n, seed)
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 1) -> int:
    return unpermute(slot * shards + shard, n, seed)


def permuted(row: Column, n: int, seed: int = 1) -> Column:
    """The permutation as a plain expression: one pass of the network, walked while out of range."""
    a, b = sides(n)

    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c"), F.lit(i % 2 == 0).alias("even")) for i, (k, c) in enumerate(_keys(seed))])

    def once(x: Column) -> Column:
        start = F.struct(F.pmod(x, F.lit(a).cast("long")).alias("l"), F.call_function("div", x, F.lit(a).cast("long")).alias("r"))

        def step(s: Column, key: Column) -> Column:
            f = lambda v: (v * key["k"] + key["c"]) % P
            mixed = lambda v: ((f(v) * f(v) + key["k"]) % P) % 1_000_003 * 1_009 + f(v) % 1_009
            return F.struct(
                F.when(key["even"], (s["l"] + mixed(s["r"])) % F.lit(a).cast("long")).otherwise(s["l"]).alias("l"),
                F.when(key["even"], s["r"]).otherwise((s["r"] + mixed(s["l"])) % F.lit(b).cast("long")).alias("r"),
            )

        return F.aggregate(keys, start, step, lambda s: s["l"] + s["r"] * F.lit(a).cast("long"))

    first = once(row)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    stuck = F.raise_error(F.lit("cycle walking did not end")).cast("long")
    return F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(stuck))[0]


def cell_of(*columns: str) -> Column:
    """One of 4096 cells, three hexadecimal digits, by all of the columns."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.substring(F.md5(F.concat_ws("|", *shown)), 1, 3)


def numbered(rows: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_no`` from 0, and their number. Rows are numbered by all their columns, the id first."""
    names = [id_col, *(c for c in rows.columns if c != id_col)]
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    counts = rows.select(*names, salt).groupBy(*names, "salt").agg(F.count("*").alias("n"))
    celled = settle(counts.withColumn("cell", cell_of(*names)), "shard-rows")
    cells = celled.groupBy("cell").agg(F.sum("n").alias("cell_rows"))
    before = F.sum("cell_rows").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cell_rows")
    offsets = settle(cells.select("cell", "cell_rows", before.alias("offset")), "shard-cells")
    total = offsets.agg(F.sum("cell_rows")).first()[0] or 0
    inside = Window.partitionBy("cell").orderBy(*[F.col(c).asc_nulls_first() for c in names], "salt").rowsBetween(Window.unboundedPreceding, 0)
    # 4096 rows at most: the cells are three hexadecimal digits
    placed = celled.join(F.broadcast(offsets.select("cell", "offset")), "cell")
    placed = placed.select(*names, "n", (F.col("offset") + F.sum("n").over(inside) - F.col("n")).alias("start"))
    # equal rows are told out in two steps, so that no array is longer than STEP or the STEP-th part of them
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / STEP).cast("bigint"))).alias("step")
    stepped = placed.select(*names, (F.col("start") + F.col("n")).alias("end"), "start", step).withColumn("low", F.col("start") + F.col("step") * STEP)
    every = F.explode(F.sequence(F.col("low"), F.least(F.col("end"), F.col("low") + STEP) - 1)).alias("row_no")
    return stepped.select(*names, every), int(total)


def shard(docs: DataFrame, shards: int = 40, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows, n = numbered(slim)
    place = F.col("place")
    return rows.select("doc_id", "size", "text_crc32", permuted(F.col("row_no"), n, seed).alias("place")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (place % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
