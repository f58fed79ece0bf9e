"""Raw documents to canonical documents: no join and no shuffle. Titles, pairs and prose of texts are read by column expressions, tables and
fixed-width lists by ``cells``, which also puts together what all of these say of a field.

Arrays of lines are worked on with higher-order functions. Whatever several
fields need is bound once with ``let``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.functions import labels, text
from tallymark.functions.text import WS
from tallymark.operators import cells
from tallymark.tables import let

# Titles of documents in the order in which they are tried, with their type.
TITLES = [
    (r"\bpro\s*forma\b", "proforma_invoice"), (r"\bshipment\s+confirmation\b", "confirmation"), (r"\bcommercial\s+invoice\b", "commercial_invoice"),
    (r"\bfattura\b", "commercial_invoice"), (r"\bpacking\s+list\b", "packing_list"), (r"\bbill\s+of\s+lading\b", "bill_of_lading"),
    (r"الفاتورة\s+الموحدة", "proforma_invoice"), (r"فاتورة\s+مبدئية", "proforma_invoice"), (r"تأكيد\s+الشحن", "confirmation"), (r"تأكيد\s+الإرسال", "confirmation"),
    (r"الفاتورة\s+التجارية", "commercial_invoice"), (r"قائمة\s+التعبئة", "packing_list"), (r"قائمة\s+التغليف", "packing_list"), (r"بوليصة\s+الشحن", "bill_of_lading"),
    (r"\bfacture\s+pro\s*forma\b", "proforma_invoice"), (r"\bconfirmation\s+d['e]expédition\b", "confirmation"), (r"\bconfirmation\s+d['e]envoi\b", "confirmation"),
    (r"\bfacture\s+commerciale\b", "commercial_invoice"), (r"\bliste\s+de\s+colisage\b", "packing_list"), (r"\bliste\s+de\s+colis\b", "packing_list"),
    (r"\bconnaissement\b", "bill_of_lading"), (r"\bfacture\b", "commercial_invoice"),
]
# A label, a colon and a value that ends before the next label or with the line.
PAIR = r"(?sU)([A-Za-z][A-Za-z\s.()/&']{1,40}?)\s*:\s*(.+?)(?=\s{2,}[A-Za-z][A-Za-z\s.()/&']{0,30}?\s*:|\z)"
# Totals in prose, by field in the order in which they are tried.
PROSE_TOTALS = {
    "net_kg": [r"total\s+net\s+weight[:\s]*([\d,\.]+)\s*kg", r"net\s*(?:wt|weight)[:\s]*([\d,\.]+)\s*kg", r"الوزن\s+الصافي[:\s]*([\d,\.]+)"],
    "gross_kg": [r"(?:total\s+)?gross\s+weight[:\s]*([\d,\.]+)\s*kg", r"gross[:\s]*([\d,\.]+)\s*kg", r"الوزن\s+(?:الإجمالي|الخام)[:\s]*([\d,\.]+)"],
    "cartons": [r"total\s+cartons[:\s]*([\d,\.]+)", r"cartons[:\s]*([\d,\.]+)", r"(?:الصناديق|كراتين)[:\s]*([\d,\.]+)"],
    "value": [r"total\s+value[:\s]*([\d,\.]+)", r"invoice\s+value[:\s]*([\d,\.]+)", r"(?:القيمة|قيمة\s+الفاتورة)[:\s]*([\d,\.]+)"],
}
# What confirmations say in running prose.
CONFIRMATION = {
    "order_no": r"\border\s+(ORD[\w\-/]+)", "reference": r"\breference\s+([\w\-/]+)", "bl_no": r"\bbill\s+of\s+lading\s+(\w+)",
    "container_no": r"\bcontainer\s+(\w+)", "vessel": r"\bvessel\s+(\w[\w\s]*?\d+\w*)",
}
BL_AGAIN = r"\bbl\s*no\.?\s*:?\s*(\w+)"
FROM_TO = r"\bfrom\s+(.+?)\s+to\s+(.+?)[,\.\n]"
CONFIRMED_TOTALS = r"total[:\s]*(\d[\d,]*)\s*cartons?,\s*net\s*([\d,\.]+)\s*kg,\s*gross\s*([\d,\.]+)\s*kg"
KEY_FIELDS = ("order_no", "bl_no", "reference", "container_no", "seal_no", "shipper", "consignee", "vessel", "pol", "pod", "ship_date", "currency")


def _group(c: Column, pattern: str, group: int = 1, flags: str = "iU") -> Column:
    """A group of the first match; null if there is none."""
    return F.when(c.rlike(f"(?{flags}){pattern}"), F.regexp_extract(c, f"(?{flags}){pattern}", group))


def doc_type(body: Column) -> Column:
    """(type, confidence): the first title found in the first 500 signs, else anywhere, else unknown."""

    def judged(full: Column) -> Column:
        head = F.substring(full, 1, 500)
        none = F.struct(F.lit("unknown").alias("type"), F.lit(0.0).alias("confidence"))

        def first(where: Column, sure: float, other: Column) -> Column:
            for pattern, kind in reversed(TITLES):
                other = F.when(where.rlike(f"(?iU){pattern}"), F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))).otherwise(other)
            return other

        return first(head, 0.9, F.when(F.length(full) > 500, first(full, 0.6, none)).otherwise(none))

    return let(text.despaced(body), judged)


def text_pairs(lines: Column, known: dict[str, str]) -> Column:
    """Label-value pairs of free text, in order: array of (f, v, l)."""

    def of(line: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(line, F.lit(PAIR), F.lit(1)).alias("l"), F.regexp_extract_all(line, F.lit(PAIR), F.lit(2)).alias("v"))
        return F.transform(both, lambda p: F.struct(labels.field_of(p["l"], known).alias("f"), text.strip(p["v"]).alias("v"), text.strip(p["l"]).alias("l")))

    found = F.flatten(F.transform(F.transform(F.filter(lines, lambda x: x.contains(":")), text.strip), of))
    return F.filter(found, lambda p: p["f"].isNotNull() & (p["v"] != ""))


def _first(pairs: Column, field: str, part: str = "v") -> Column:
    """What the first pair of a field says: arrays of one part are searched without a function for each pair."""
    return F.get(pairs[part], F.array_position(pairs["f"], field).cast("int") - 1)


def _last(pairs: Column, field: str, part: str = "v") -> Column:
    return _first(F.reverse(pairs), field, part)


def confirmation(body: Column) -> Column:
    """What a confirmation says in prose: struct of fields."""
    found = {k: _group(body, v) for k, v in CONFIRMATION.items()}
    found["bl_no"] = F.coalesce(found["bl_no"], _group(body, BL_AGAIN))
    found["vessel"] = text.strip(F.regexp_replace(text.strip(found["vessel"]), rf"(?iU){WS}+voyage\b", ""))
    found |= {k: text.strip(_group(body, FROM_TO, i)) for i, k in enumerate(("shipper", "consignee"), 1)}
    return F.struct(*[v.alias(k) for k, v in found.items()])


def prose_totals(body: Column) -> Column:
    raw = {k: F.coalesce(*[_group(body, p) for p in patterns]) for k, patterns in PROSE_TOTALS.items()}
    return F.struct(*[(text.integer(v) if k == "cartons" else text.number(v)).alias(k) for k, v in raw.items()])


def confirmed_totals(body: Column) -> Column:
    part = lambda i: _group(body, CONFIRMED_TOTALS, i)
    return F.struct(text.integer(part(1)).alias("cartons"), text.number(part(2)).alias("net_kg"), text.number(part(3)).alias("gross_kg"))


def unresolved_labels(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, label): labels of lines and of first rows that the dictionary does not know."""
    known = known or labels.dictionary()
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), text.strip)
    in_text = F.transform(F.filter(lines, lambda x: x.rlike(f"{PAIR[:5]}^(?:{PAIR[5:]})")), lambda x: text.strip(F.regexp_extract(x, PAIR, 1)))
    in_tables = F.flatten(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t: F.coalesce(F.get(t, F.lit(0)), F.array().cast("array<string>"))))
    every = docs.select("doc_id", F.explode(F.concat(in_text, F.transform(in_tables, lambda c: text.strip(F.coalesce(c, F.lit("")))))).alias("label"))
    return every.where((F.col("label") != "") & labels.field_of(F.col("label"), known).isNull()).distinct()


def resolve_labels(unresolved: DataFrame, resolver, batch: int = 64, most: int = 10_000) -> dict[str, str]:
    """Ask ``resolver`` (list of labels to dict of fields) for labels, in batches on the executors.

    Returns what can be passed as ``extra`` to the dictionary: one entry for each distinct label. More than
    ``most`` resolved labels are no dictionary but a sign of wrong input, and an error.
    """
    valid = labels.fields() - {"pack", "tare_kg", "origin_country", "notify_party"}

    def ask(batches):
        import pandas as pd

        for frame in batches:
            names = frame["label"].tolist()
            for i in range(0, len(names), batch):
                got = {k: v for k, v in (resolver(names[i : i + batch]) or {}).items() if v in valid}
                yield pd.DataFrame({"label": list(got), "field": list(got.values())}, dtype="object")

    rows = unresolved.select("label").distinct().mapInPandas(ask, "label string, field string")
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} labels were resolved")
    return {r["label"]: r["field"] for r in found}


def extract(docs: DataFrame, extra_labels: dict[str, str] | None = None, label_values: bool = False) -> DataFrame:
    """RAW to CANONICAL. Tables win over free text, free text over confirmation prose.

    ``label_values`` keeps values instead of labels in raw_field_labels for what comes from pairs.
    """
    known = labels.dictionary(extra_labels)
    body = F.coalesce(F.col("text"), F.lit(""))
    own = [c.split()[0] for c in schema.RAW.split(", ")]
    given = docs.select(*own, doc_type(body).alias("_type"))
    sure = F.col("_type.type") == "confirmation"
    # every pattern of prose has a number, and every pair a colon
    read = given.select(
        *[c for c in own if c not in ("text", "tables")], "_type", F.when(body.rlike(r"(?U)[\d,.]"), prose_totals(body)).alias("_prose"), F.when(sure, confirmed_totals(body)).alias("_said_totals"),
        "text", "tables", F.when(body.contains(":"), text_pairs(F.split(body, "\n"), known)).alias("_text"), F.when(sure, confirmation(body)).alias("_said"),
    )
    read = cells.merged(read, known, KEY_FIELDS, label_values)
    items, total = F.col("line_items"), lambda name, field: F.col(f"{name}.{field}")
    empty = lambda *names: reduce(lambda a, b: a & b, [F.coalesce(*[total(n, f) for n in names]).isNull() for f in ("net_kg", "gross_kg", "cartons")])
    none_in_tables = empty("_totals")
    read = read.withColumn("_prose", F.when(none_in_tables, F.col("_prose")))
    read = read.withColumn("_said_totals", F.struct(*[F.when(total("_said_totals", f) != 0, total("_said_totals", f)).alias(f) for f in ("cartons", "net_kg", "gross_kg")]))
    read = read.withColumn("_fixed_totals", F.when(empty("_totals", "_prose", "_said_totals"), F.col("_fixed_totals")))

    def summed(field: str, kind: str) -> Column:
        all_of = F.aggregate(items, F.lit(0).cast(kind), lambda a, i: a + F.coalesce(i[field], F.lit(0).cast(kind)))
        return let(all_of, lambda s: F.when(s > 0, s if kind == "bigint" else text.rounded(s, 2)))

    chain = lambda f, item, kind: F.coalesce(total("_totals", f), total("_prose", f), total("_said_totals", f), total("_fixed_totals", f), summed(item, kind))
    totals = F.struct(
        chain("cartons", "cartons", "bigint").alias("cartons"), chain("net_kg", "net_kg", "double").alias("net_kg"), chain("gross_kg", "gross_kg", "double").alias("gross_kg"),
        F.coalesce(total("_totals", "value"), total("_prose", "value"), summed("amount", "double")).alias("value"), F.col("_currency").alias("currency"),
    )
    kv = lambda f: F.col(f"_{f}")
    vessel = kv("vessel")
    halves = F.split(vessel, rf"(?U){WS}*/{WS}*", 2)
    tail = r"(?U)^(.+?)\s+(\d+\w*)$"
    split_tail = (F.size(halves) == 1) & vessel.rlike(tail)
    ship = F.when(split_tail, text.strip(F.regexp_extract(vessel, tail, 1))).otherwise(text.blank_to_null(text.strip(F.get(halves, F.lit(0)))))
    trip = F.when(split_tail, F.regexp_extract(vessel, tail, 2)).otherwise(text.strip(F.get(halves, F.lit(1))))
    out = read.select(
        "doc_id", "source_path", F.col("_type.type").alias("doc_type"), "source_format",
        F.struct(*[(text.container(kv(f)) if f == "container_no" else kv(f)).alias(f) for f in schema.IDENTIFIERS]).alias("identifiers"),
        F.struct(*[text.party(kv(f)).alias(f) for f in schema.PARTIES]).alias("parties"),
        F.struct(ship.alias("vessel"), trip.alias("voyage"), *[kv(f).alias(f) for f in ("pol", "pod", "ship_date")]).alias("logistics"),
        "line_items", totals.alias("totals"), F.col("_type.confidence").alias("_base"),
        F.col("_labels").alias("raw_field_labels"), "doc_ord",
    )
    seen = lambda c: F.when(c, 1).otherwise(0)
    keys = [F.col("identifiers.order_no"), F.col("identifiers.bl_no"), F.col("identifiers.container_no"), F.col("parties.shipper"), F.col("parties.consignee")]
    points = sum((seen(c.isNotNull()) for c in keys), F.lit(0)) + 2 * seen(F.size("line_items") > 0)
    points = points + seen(F.col("totals.net_kg").isNotNull() | F.col("totals.gross_kg").isNotNull()) + seen(F.col("totals.cartons").isNotNull())
    sure = let(F.col("_base") + 0.05 * points, lambda x: F.when(x >= 1.0, F.lit(1.0)).otherwise(text.rounded(x, 2)))
    return out.withColumn("extraction_confidence", sure).select(*[c.split()[0] for c in (
        "doc_id", "source_path", "doc_type", "source_format", "identifiers", "parties", "logistics", "line_items", "totals", "extraction_confidence", "raw_field_labels", "doc_ord")])
