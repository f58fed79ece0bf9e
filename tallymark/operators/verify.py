"""Groups to findings and verdicts: one plan for all fields instead of a comparator for each.

Every value that a document states is a fact; per group and path the facts vote, and facts
that differ from the winner are findings. Only facts of paths with disagreement, found by
aggregates of each group, are made rows, voted on and met again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.functions import text
from tallymark.tables import of_keys, settle

FAILING = ("high", "medium")
ITEM_NUMBERS, ITEM_COUNTS = ("net_kg", "gross_kg", "unit_price", "amount"), ("cartons",)


def _fact(path: Column, severity: str, shown: Column, key: Column, num: Column | None = None, tolerant: bool = False) -> Column:
    return F.struct(
        path.alias("path"), F.lit(severity).alias("severity"), F.lit(tolerant).alias("tolerant"), shown.alias("shown"), key.alias("key"),
        (num if num is not None else F.lit(None)).cast("double").alias("num"),
    )


def _number(path: Column, c: Column, severity: str, tolerant: bool) -> Column:
    shown = text.shown_double(c) if tolerant else c.cast("string")
    return _fact(path, severity, shown, c.cast("string"), c, tolerant)


def section_facts() -> list[Column]:
    at = lambda s, f: (F.lit(f"{s}.{f}"), F.col(f"{s}.{f}"))
    out = [_fact(p, "high", c, text.identifier(c)) for p, c in (at("identifiers", f) for f in schema.IDENTIFIERS)]
    out += [_number(*at("totals", f), "high", True) for f in ("net_kg", "gross_kg", "value")]
    out += [_number(*at("totals", "cartons"), "high", False)]
    out += [_fact(p, "high", c, c) for p, c in (at("totals", "currency"),)]
    out += [_fact(p, "medium", c, text.comparable(c)) for p, c in (at("parties", f) for f in schema.PARTIES)]
    return out + [_fact(p, "low", c, text.comparable(c)) for p, c in (at("logistics", f) for f in schema.LOGISTICS)]


def item_rows(members: DataFrame) -> DataFrame:
    """Line items that can be findings, with how they are matched: (group_id, doc_id, doc_ord, idx, prefix, label, several, item).

    First by lot, of equal lots in a document the last; what no other document has by lot, and
    what a later equal lot replaced, goes on to be matched by description. Items that several documents
    have, and all with the same numbers, are left out where that is first known.
    """
    kept = ("description", *ITEM_NUMBERS, *ITEM_COUNTS)
    items = members.select("group_id", "doc_id", "doc_ord", F.posexplode("line_items").alias("idx", "i"))
    items = items.select("group_id", "doc_id", "doc_ord", "idx", F.col("i.lot").alias("lot"), F.struct(*[F.col(f"i.{f}") for f in kept]).alias("item"))

    def matched(rows: DataFrame, key: str) -> DataFrame:
        group, doc = Window.partitionBy("group_id", key), Window.partitionBy("group_id", key, "doc_ord")
        alike = reduce(lambda a, b: a & b, [F.coalesce(F.min(f"item.{f}").over(group) == F.max(f"item.{f}").over(group), F.lit(True)) for f in (*ITEM_NUMBERS, *ITEM_COUNTS)])
        # all windows are met by one shuffle on group and key
        return rows.repartition("group_id", key).select("*", (F.max("idx").over(doc) == F.col("idx")).alias("last"), (F.min("doc_ord").over(group) != F.max("doc_ord").over(group)).alias("several"), alike.alias("alike"))

    matters = "last and not (several and alike)"
    lots = matched(items.where("lot <> ''"), "lot")
    by_lot = lots.where(matters).withColumn("prefix", F.concat(F.lit("line_items[lot="), "lot", F.lit("]"))).withColumn("label", F.col("lot"))
    rest = items.where("lot is null or lot = ''").drop("lot").unionByName(lots.where("not (last and several)").drop("lot", "last", "several", "alike"))
    rest = rest.where("item.description <> ''").withColumn("name", text.comparable(F.col("item.description")))
    by_name = matched(rest, "name").where(matters).withColumn("prefix", F.concat(F.lit("line_items[desc="), "name", F.lit("]"))).withColumn("label", F.col("item.description"))
    columns = ["group_id", "doc_id", "doc_ord", "idx", "prefix", "label", "several", "item"]
    return by_lot.select(columns).unionByName(by_name.select(columns))


def _differ(keys: list[tuple[str, Column]]) -> tuple[list[Column], Column]:
    """Aggregates of named keys, and the names of those that have two values or more."""
    aggregates = [agg(k).alias(f"{end}{i}") for i, (_, k) in enumerate(keys) for end, agg in (("low", F.min), ("high", F.max))]
    names = F.array(*[F.when(F.col(f"low{i}") != F.col(f"high{i}"), F.lit(name)) for i, (name, _) in enumerate(keys)])
    return aggregates, F.filter(names, lambda n: n.isNotNull())


def _stated(fact: Column) -> Column:
    """A fact's key, where it states anything: what has no normal form is a value of its own."""
    return F.when(fact["shown"].isNotNull(), F.coalesce(fact["key"], F.lit("\0")))


def facts(members: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(group_id, doc_id, doc_ord, path, severity, tolerant, shown, key, num) of the values of all paths that documents disagree on.

    Which these are is told by the smallest and largest key, combined before any shuffle; only
    those facts are made rows.
    """
    keys = [*((f"{s}.{c}", s, c) for s, names in (("identifiers", schema.IDENTIFIERS), ("totals", ("net_kg", "gross_kg", "value", "cartons", "currency")), ("parties", schema.PARTIES), ("logistics", schema.LOGISTICS)) for c in names)]
    aggregates, names = _differ([(name, _stated(f)) for (name, _, _), f in zip(keys, section_facts(), strict=True)])
    disputed = members.groupBy("group_id").agg(*aggregates).select("group_id", names.alias("paths")).where("size(paths) > 0")
    told = lambda f: f["shown"].isNotNull() & F.array_contains("paths", f["path"])
    wide = members.join(disputed, "group_id").select("group_id", "doc_id", "doc_ord", F.inline(F.filter(F.array(*section_facts()), told)))
    items = item_rows(members) if items is None else items
    several = items.where("several")
    values = [(f, "high", True) for f in ITEM_NUMBERS] + [(f, "high", False) for f in ITEM_COUNTS]
    aggregates, names = _differ([(f, F.col(f"item.{f}")) for f, _, _ in values])
    disputed = several.groupBy("group_id", "prefix").agg(*aggregates).select("group_id", "prefix", names.alias("fields")).where("size(fields) > 0")
    each = F.array(*[F.struct(F.lit(f).alias("f"), _number(F.concat("prefix", F.lit(f".{f}")), F.col(f"item.{f}"), severity, tolerant).alias("fact")) for f, severity, tolerant in values])
    own = F.transform(F.filter(each, lambda x: F.array_contains("fields", x["f"]) & x["fact"]["shown"].isNotNull()), lambda x: x["fact"])
    narrow = several.join(disputed, ["group_id", "prefix"]).select("group_id", "doc_id", "doc_ord", F.inline(own))
    return wide.unionByName(narrow)


def disagreements(stated: DataFrame) -> DataFrame:
    """(group_id, path, total, n_keys, win) of paths with two values or more that differ; win is the vote's winner."""
    first = F.min(F.struct("doc_ord", "doc_id", "shown", "num"))
    counts = stated.groupBy("group_id", "path", "key").agg(F.count("*").alias("n"), first.alias("first"))
    win = F.max(F.struct("n", (-F.col("first.doc_ord")).alias("order"), F.struct("first.doc_id", "first.shown", "first.num", "key").alias("it")))
    return counts.groupBy("group_id", "path").agg(F.sum("n").alias("total"), F.count("*").alias("n_keys"), win.alias("win")).where("n_keys > 1")


def _likeness(members: DataFrame) -> DataFrame:
    """(group_id, sections_differ, items_differ), a row for each group: where its documents are not all alike.

    Documents that state the same, to the letter, have no findings, so that votes and items are worked on only where
    they can differ. Statements are compared as JSON, in which nulls and names have their places, by 128 bits of their hash.
    """
    said = members.select("group_id", F.to_json(F.struct("identifiers", "totals", "parties", "logistics")).alias("sections"), F.to_json("line_items").alias("items"))
    said = said.select("group_id", *[F.xxhash64(F.lit(salt), c).alias(f"{c}{salt}") for c in ("sections", "items") for salt in (1, 2)])
    differ = lambda c: ((F.min(f"{c}1") != F.max(f"{c}1")) | (F.min(f"{c}2") != F.max(f"{c}2"))).alias(f"{c}_differ")
    return said.groupBy("group_id").agg(differ("sections"), differ("items"))


def apart(members: DataFrame) -> DataFrame:
    """(group_id, sections_differ, items_differ) of the groups whose documents are not all alike."""
    return _likeness(members).where("sections_differ or items_differ")


def findings(members: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """FINDINGS with (sev_rank, n_key, first_ord, ord_b) to order them by.

    ``members`` are canonical documents with their group_id.
    """
    told = settle(_likeness(members), "apart")
    n = told.agg(F.count("*").alias("all"), *[F.count_if(f"{c}_differ").alias(c) for c in ("sections", "items")]).first()

    def where(which: str, *columns: str) -> DataFrame:
        return of_keys(members.select("group_id", "doc_id", "doc_ord", *columns), told.where(f"{which}_differ").select("group_id"), "group_id", n[which])

    if 2 * n["items"] > n["all"]:  # most groups: their items pass one shuffle, and what is left of the others is dropped after it
        items = item_rows(members.where("group_id is not null")).join(told.where("not items_differ").select("group_id"), "group_id", "left_anti")
    else:
        items = item_rows(where("items", "line_items"))
    items = settle(items, "item-rows")
    members = settle(where("sections", "identifiers", "totals", "parties", "logistics"), "apart-sections")
    stated = settle(facts(members, items), "facts")
    votes = disagreements(stated).select("group_id", "path", "total", "n_keys", F.col("win.n").alias("agree"), F.col("win.it").alias("it"))
    others = stated.join(votes, ["group_id", "path"]).where(~F.col("key").eqNullSafe(F.col("it.key")))
    near = F.coalesce(F.col("tolerant") & F.lit(tolerance > 0) & (F.abs(F.col("num") - F.col("it.num")) <= tolerance), F.lit(False))
    # each key's weight orders findings of one path as the vote ranked the keys
    of_key = Window.partitionBy("group_id", "path", "key")
    others = others.select("*", F.count("*").over(of_key).alias("n_key"), F.min("doc_ord").over(of_key).alias("first_ord")).where(~near)
    ambiguous = F.concat("path", F.lit(" mismatch: "), "it.shown", F.lit(" vs "), "shown", F.lit(" (ambiguous -- only 2 docs)"))
    outvoted = F.concat("path", F.lit(" mismatch: "), F.col("agree").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" docs show "), "it.shown", F.lit(", doc shows "), "shown")
    message = F.when((F.col("total") == 2) & (F.col("n_keys") == 2), ambiguous).otherwise(outvoted)
    compared = others.select(
        "group_id", F.col("path").alias("field"), F.col("it.doc_id").alias("doc_a"), F.col("it.shown").alias("value_a"), F.col("doc_id").alias("doc_b"),
        F.col("shown").alias("value_b"), "severity", message.alias("message"), "n_key", "first_ord", F.col("doc_ord").alias("ord_b"),
    )
    single = items.where("not several").select(
        "group_id", F.col("prefix").alias("field"), F.col("doc_id").alias("doc_a"), F.col("label").alias("value_a"), F.col("doc_id").alias("doc_b"),
        F.lit("not present in other documents").alias("value_b"), F.lit("low").alias("severity"),
        F.concat(F.lit("Line item '"), "label", F.lit("' only found in one document")).alias("message"),
        F.lit(1).cast("bigint").alias("n_key"), F.col("doc_ord").alias("first_ord"), F.col("doc_ord").alias("ord_b"),
    )
    rank = F.array_position(F.array(*map(F.lit, schema.SEVERITIES)), F.col("severity")).cast("int")
    return compared.unionByName(single).withColumn("sev_rank", rank)


def ordered(found: DataFrame) -> DataFrame:
    """Findings with their place in the group."""
    w = Window.partitionBy("group_id").orderBy("sev_rank", "field", F.desc("n_key"), "first_ord", "ord_b")
    return found.withColumn("place", F.row_number().over(w))


def suspects(found: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, doc_id): documents that differ; in groups of two with any finding, both."""
    of_two = members.groupBy("group_id").agg(F.count("*").alias("m"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("m = 2")
    both = of_two.join(found.select("group_id").distinct(), "group_id", "left_semi").select("group_id", F.explode(F.array("x", "y")).alias("doc_id"))
    return found.select("group_id", F.col("doc_b").alias("doc_id")).union(both).distinct()


def verdicts(found: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, verdict, suspect_doc_ids, n_docs, n_findings), one row a group; groups of one pass."""
    bad = found.groupBy("group_id").agg(F.bool_or(F.col("severity").isin(*FAILING)).alias("fails"), F.count("*").alias("n_findings"))
    who = suspects(found, members).groupBy("group_id").agg(F.array_sort(F.collect_set("doc_id")).alias("suspect_doc_ids"))
    groups = members.groupBy("group_id").agg(F.count("*").alias("n_docs"))
    out = groups.join(bad, "group_id", "left").join(who, "group_id", "left")
    verdict = F.when(F.coalesce("fails", F.lit(False)), "FAIL").otherwise("PASS")
    return out.select("group_id", verdict.alias("verdict"), F.coalesce("suspect_doc_ids", F.array().cast("array<string>")).alias("suspect_doc_ids"), "n_docs", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
