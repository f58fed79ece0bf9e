"""Tables read a batch at once, against the plain definition in column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import labels, text
from tallymark.operators import cells
from tallymark.tables import let
from tests import plain_cells as plain

TABLES = [
    [], [[]], [[None, "x"], []], [["Order No", "A1", "", "B/L No:", " B2 "], ["الحاوية", None], ["Seal  No.", ""]],
    [["Lot", "Description", "Cartons", "Net Weight", "Amount", "Amount"], ["L1", "Pasta", "1.234", "1.234,5", "7", ""], ["L2", " Rice ", "x", "EUR 3", "", "€ 8"], ["L3", "Specimen a", "1", "2", "3", "4"], ["TOTAL", "", "n/a", "٣", "9"]],
    [["Description", "Cartons", "Unit Price"], ["Pasta", "3", "2.675"], ["اجمالي", "5", "1"], ["Oil", "12 CTNS", "1 234,5"], ["Tea", "-4", "1e3", "more"]],
    [["Buyer", "x"], ["Order No", "A2", None, "Order No", "A3"]], [["Order No", "Description", "Lot"]], [["total", "Description", "Cartons", "Net kg"], ["totale", "Salt", "7 ", ".5 kg"], ["Montant", None, "8", "1,2,3"]],
    [["Description", "Cartons"], ["a", "99999999999999999999"]], [["x", "y"], ["z", "w"]], [["Cartons", "Net wt", "Description"], ["2", "1.5", "b"], ["Description", "Lot", "Cartons", "Net wt"], ["c", "l", "4", "2"]],
]
DOCS = [None, [], *[[t] for t in TABLES], TABLES, TABLES[::-1], [TABLES[3], TABLES[4]]]


def test_cells_equal_the_plain_definition(spark):
    known = labels.dictionary()
    docs = spark.createDataFrame(list(enumerate(DOCS * 2)), "doc_ord bigint, tables array<array<array<string>>>").repartition(2)
    structured = F.exists(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t: (F.size(t) > 1) & F.exists(t, lambda r: F.size(r) >= 2))
    both = docs.select("*", structured.alias("s"), let(plain.labelled(F.col("tables"), known), lambda c: F.struct(plain.table_pairs(c).alias("pairs"), plain.with_headers(c).alias("headed"))).alias("c"))
    heads = F.flatten(F.transform("c.headed", lambda t: F.filter(t["head"], lambda c: c["f"].isNotNull())))
    total = F.when(F.col("s"), plain.table_totals(F.col("c.headed")))
    want = both.select("doc_ord", F.col("c.pairs").alias("_pairs"), F.when(F.col("s"), heads).alias("_heads"), F.when(F.col("s"), plain.line_items(F.col("c.headed"))).alias("_items"), F.struct(*[total[f].alias(f) for f in ("cartons", "net_kg", "gross_kg", "value")]).alias("_totals"))
    got = cells.read(docs, known).orderBy("doc_ord").collect()
    for g, w in zip(got, want.orderBy("doc_ord").collect(), strict=True):
        assert g.asDict(recursive=True) == w.asDict(recursive=True)


def test_numbers_equal_text_number(spark):
    said = ["1", "1.5", "1,234.50", "1 234 567", "12 CTNS", "1.234", "1.234,5", "EUR 5", "€ EUR 5", "5 kg", "1,2", "1,2,3", "-7", "+.5", "1e3", "1e999", "", "kg", "٣٫٥", "٣", " 4 ", "12345678901234567890", "1,23.4", "0.125"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", text.number(F.col("s")).alias("n"), text.integer(F.col("s")).alias("k")).orderBy("i").collect()
    import pyarrow as pa

    found = cells.numbers(pa.array(said))
    assert found.to_pylist() == [r["n"] for r in rows]
    assert cells.whole(found).to_pylist() == [r["k"] for r in rows]


def test_shapes_of_one_row_group_are_many_tasks(spark, tmp_path):
    from tallymark.plans import text_queries

    spark.range(100).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    docs = text_queries._shapes(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() >= 4 and docs.count() == 100


def test_small_messages_come_in_one_batch(spark, tmp_path):
    from tallymark.streaming import inbox

    for i in range(120):
        (tmp_path / f"{i}.eml").write_bytes(b"Subject: x\n\n")
    sizes = []
    query = inbox.messages(spark, str(tmp_path)).writeStream.foreachBatch(lambda batch, n: sizes.append(batch.count())).trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/seen").start().awaitTermination()
    assert sizes == [120]


def test_groups_of_like_documents_are_left_out(spark):
    from tallymark import schema
    from tallymark.operators import verify as ve

    def doc(group, number, order=None, bill=None, reference=None, lots=("A",)):
        items = [(f"Part {lot}", lot, 1, 1.0, 1.0, None, None, None) for lot in lots]
        return (f"d{number}", None, "packing_list", "docx", (order, bill, reference, None, None), (None, None), (None,) * 5, items, (None,) * 5, 1.0, None, number, group)

    rows = [doc("same", 1, "X", "Y"), doc("same", 2, "X", "Y"), doc("moved", 3, "X", "Y"), doc("moved", 4, None, "X", "Y"), doc("items", 5, "X"), doc("items", 6, "X", lots=("A", "B")), doc("alone", 7, "X")]
    members = spark.createDataFrame(rows, f"{schema.CANONICAL}, group_id string")
    found = {(r["group_id"], r["sections_differ"], r["items_differ"]) for r in ve.apart(members).collect()}
    assert found == {("moved", True, False), ("items", False, True)}
    assert {(r["group_id"], r["field"]) for r in ve.findings(members).collect()} == {("moved", "identifiers.bl_no"), ("items", "line_items[lot=B]"), ("items", "line_items[desc=part b]")}


def test_fixed_width_lists_are_read_once():
    body = "LIST\nLOT         Description   Colli    Peso Netto kg  Peso Lordo kg\n-----\n A1234B     x\nL1234A      Pasta 5       1,000    6.402,00       7000\nTOTAL                     1120     6903.5         7602"
    # places come from the first line of data, which has fewer columns than the header names
    assert cells.fixed_width(body) == ([], [None] * 3)
    items, totals = cells.fixed_width(body.replace(" A1234B     x\n", ""))
    assert items == [["L1234A", "Pasta 5", "1,000", "6.402,00", "7000"]] and totals == ["1120", "6903.5", "7602"]
    assert cells.fixed_width("a\nb") == ([], [None] * 3)


def test_tables_win_over_text_and_text_over_prose(spark):
    from tallymark import schema
    from tallymark.operators import extract as ex

    said = "SHIPMENT CONFIRMATION\nWe confirm order ORD-1 (reference R9) from A to B,\nOrder No: ORD-2\nOrder No: ORD-3\nSeal No: S1"
    tables = [[["Order No", "ORD-4"], ["Order No", "ORD-5"]], [["Order No", "Description", "Lot"], ["x", "y", "z"]]]
    rows = [("d0", None, None, said, [], 0), ("d1", None, None, said, tables[:1], 1), ("d2", None, None, said, tables, 2)]
    out = [ex.extract(spark.createDataFrame(rows, schema.RAW), label_values=v).orderBy("doc_ord").collect() for v in (False, True)]
    assert [(r["identifiers"]["order_no"], r["identifiers"]["reference"], r["identifiers"]["seal_no"]) for r in out[0]] == [("ORD-3", "R9", "S1"), ("ORD-4", "R9", "S1"), ("ORD-4", "R9", "S1")]
    labelled = {"order_no": "Order No", "reference": "reference", "seal_no": "Seal No", "shipper": "shipper", "consignee": "consignee"}
    assert [r["raw_field_labels"] for r in out[0]] == [labelled, labelled, labelled | {"description": "Description", "lot": "Lot"}]
    assert [r["raw_field_labels"]["order_no"] for r in out[1]] == ["ORD-3", "ORD-4", "Order No"]


def test_orders_are_rendered_before_they_become_documents(spark, tmp_path):
    from tallymark.sources import corpus

    spark.sql("SELECT 1L AS o_orderkey, 2L AS o_custkey, DATE'2024-01-02' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS l_orderkey, 1L AS l_linenumber, 3L AS l_partkey, 4.0D AS l_quantity, 10.0D AS l_extendedprice, 5L AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = corpus.raw(spark, str(tmp_path))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert above.count("format_number") == 2 and below.count("format_number") > 2  # above: the sentence of confirmations, on few orders
    assert [r["tables"][1][1] for r in docs.collect()] == [["L000003-1", "Part 3", "4 CTNS", "10,00", "12,00", "2,50", "10,00"]] * 3
