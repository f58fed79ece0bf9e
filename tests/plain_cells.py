"""What tables of documents say, as column expressions: the plain definition that ``operators.cells`` is held against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import labels, text
from tallymark.operators.cells import ITEM_FIELDS, TOTAL_ARABIC, TOTAL_WORDS
from tallymark.operators.extract import _first
from tallymark.tables import let


def labelled(tables: Column, known: dict[str, str]) -> Column:
    """Cells with the fields that they name: array of tables of rows of (v, f)."""
    every = F.coalesce(tables, F.array().cast("array<array<array<string>>>"))
    each = lambda nested, cell: F.transform(nested, lambda t: F.transform(t, lambda r: F.transform(r, cell)))
    shown = lambda c, at: F.substring(c, at, 1).between("!", "~")  # noqa: E731  # ASCII, and no white space
    plain = each(every, lambda c: F.when(shown(c, 1) & shown(c, -1), c).otherwise(text.strip(F.coalesce(c, F.lit("")))))
    return each(plain, lambda v: F.struct(v.alias("v"), labels.field_of(v, known, stripped=True).alias("f")))


def _named(row: Column) -> Column:
    return F.filter(row, lambda c: c["f"].isNotNull())


def table_pairs(cells: Column) -> Column:
    """Pairs of the tables that are not item tables, from columns 1-2 and 4-5."""

    def of_row(row: Column) -> Column:
        pair = lambda i: F.struct(F.get(row, F.lit(i))["f"].alias("f"), F.get(row, F.lit(i + 1))["v"].alias("v"), F.get(row, F.lit(i))["v"].alias("l"))
        return F.filter(F.array(pair(0), pair(3)), lambda p: p["f"].isNotNull() & (p["v"] != ""))

    metadata = F.filter(cells, lambda t: F.coalesce(F.size(_named(F.get(t, F.lit(0)))), F.lit(0)) < 3)
    return F.flatten(F.transform(metadata, lambda t: F.flatten(F.transform(t, of_row))))


def header_row(table: Column) -> Column:
    """Place of the header row from 0, or -1: the row with most known labels, item labels before others."""

    def score(row: Column) -> Column:
        names = F.transform(_named(row), lambda c: c["f"])
        extra = F.when(F.array_contains(names, "description"), 100).otherwise(0) + F.when(F.arrays_overlap(names, F.array(*map(F.lit, ITEM_FIELDS))), 50).otherwise(0)
        return F.when(F.size(names) >= 2, F.size(names) + F.coalesce(extra, F.lit(0))).otherwise(-1)

    return let(F.transform(table, score), lambda s: F.when(F.array_max(s) > 0, F.array_position(s, F.array_max(s)).cast("int") - 1).otherwise(-1))


def with_headers(cells: Column) -> Column:
    """Tables that have a header: array of (head, rows); rows are those below it."""
    found = F.transform(cells, lambda t: let(header_row(t), lambda at: F.struct(at.alias("at"), F.get(t, at).alias("head"), F.slice(t, at + 2, F.greatest(F.size(t), F.lit(1))).alias("rows"))))
    return F.filter(found, lambda t: t["at"] >= 0)


def _by_field(head: Column, row: Column) -> Column:
    """The filled cells of a row with the fields of their columns: array of (f, v)."""
    at = F.transform(head, lambda h, i: F.struct(h["f"].alias("f"), F.get(row, i)["v"].alias("v")))
    return F.filter(at, lambda c: c["f"].isNotNull() & c["v"].isNotNull() & (c["v"] != ""))


def line_items(tables: Column) -> Column:
    """Items of all tables with headers, in order; rows of totals, marks and blanks left out."""

    def item(cells: Column) -> Column:  # last cell first
        parsed = F.struct(
            _first(cells, "description").alias("description"), _first(cells, "lot").alias("lot"),
            text.integer(_first(cells, "cartons")).alias("cartons"), text.number(_first(cells, "net_kg")).alias("net_kg"),
            text.number(_first(cells, "gross_kg")).alias("gross_kg"), text.number(_first(cells, "unit_price")).alias("unit_price"),
            text.integer(_first(cells, "units")).alias("units"), text.number(_first(cells, "amount")).alias("amount"),
        )
        return let(parsed, lambda p: p.withField("amount", F.coalesce(p["amount"], text.rounded(p["unit_price"] * p["cartons"], 2))))

    def of_table(t: Column) -> Column:
        rows = F.transform(t["rows"], lambda r: F.reverse(_by_field(t["head"], r)))

        def real(cells: Column) -> Column:
            named = lambda name: let(F.lower(name), lambda low: name.isNotNull() & ~(low.startswith("total") | low.startswith("specimen") | name.isin(*TOTAL_ARABIC)))
            return let(_first(cells, "description"), named)

        return F.transform(F.filter(rows, real), item)

    return F.flatten(F.transform(tables, of_table))


def table_totals(tables: Column) -> Column:
    """Totals of the rows that say so: the first number of each field."""

    def of_table(t: Column) -> Column:
        says = lambda r: F.exists(r, lambda c: F.lower(c["v"]).isin(*TOTAL_WORDS) | c["v"].isin(*TOTAL_ARABIC))
        return F.flatten(F.transform(F.filter(t["rows"], says), lambda r: _by_field(t["head"], r)))

    def first(cells: Column, field: str, parse) -> Column:
        numbers = F.transform(F.filter(cells, lambda c: c["f"] == field), lambda c: parse(c["v"]))
        return F.get(F.filter(numbers, lambda x: x.isNotNull()), F.lit(0))

    return let(
        F.flatten(F.transform(tables, of_table)),
        lambda cells: F.struct(
            first(cells, "cartons", text.integer).alias("cartons"), first(cells, "net_kg", text.number).alias("net_kg"),
            first(cells, "gross_kg", text.number).alias("gross_kg"), first(cells, "amount", text.number).alias("value"),
        ),
    )
