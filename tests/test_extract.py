"""Scalar functions and extraction on the fixture shapes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.functions import labels, text
from tallymark.operators import extract as ex

NUMBERS = {
    "6,402.00": 6402.0, "€6,402.00": 6402.0, "6.402,00": 6402.0, "6402": 6402.0, "6 402": 6402.0, "USD 12,345": 12345.0, "EUR 191,161.76": 191161.76,
    "4 967": 4967.0, "1.234.567,89": 1234567.89, "€ 6 402": 6402.0, "$1,234.56": 1234.56, "-42.5": -42.5, "3.14": 3.14, "0": 0.0, "": None, "abc": None, None: None,
    "1.234": 1234.0, "0.500": 500.0, "-6.402,00": None, "٤٩٦٧": 4967.0, "5d": None, " 42\t": 42.0, "1119 CTNS": 1119.0, "50829.00 KG": 50829.0, "6,42": 6.42, "1,2,3": 123.0, "1,2345": 12345.0, "12e3": 12000.0,
}


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column).collect()]


def test_numbers(spark):
    assert one(spark, text.number(F.col("v")), *NUMBERS) == list(NUMBERS.values())
    assert one(spark, text.integer(F.col("v")), "1119 CTNS", "-3.9", "x", "1e30") == [1119, -3, None, None]


def test_strings(spark):
    v = F.col("v")
    assert one(spark, text.identifier(v), "ord-2026-77566", "A.B.C", " -/. ", None, "a b") == ["ORD202677566", "ABC", None, None, "AB"]
    a, b, c = one(spark, text.content_hash(v), "Hello  World", "hello world\n", "")
    assert a == b != c and len(c) == 64
    assert one(spark, text.container(v), "WSHZ2980815  40'HC", "X1", "  ") == ["WSHZ2980815", "X1", None]
    assert one(spark, text.party(v), "Acme Co.\nStreet 1", "Beta, LLC ,.", ". ,") == ["Acme Co", "Beta, LLC", None]
    assert one(spark, text.comparable(v), " MV\tTest ", "É  a") == ["mv test", "é a"]
    assert one(spark, text.despaced(v), "P A C K I N G   L I S T", "A plan B") == ["PACKING LIST", "A plan B"]
    assert one(spark, text.shipment_prefix(v), "/x/s01_invoice.docx", "/x/other.docx") == ["S01", None]
    assert one(spark, text.indel_ratio(v, F.lit("ORD202677567")), "ORD202677566", "ORD202677567", "", None) == [pytest.approx(22 / 24), 1.0, 0.0, None]
    shown = one(spark, text.shown_double(v.cast("double")), "1e7", "12345678.9", "2.5", "0.0005", "100")
    assert shown == ["10000000.0", "12345678.9", "2.5", "0.0005", "100.0"]
    assert one(spark, text.group_name(v.cast("int")), "1", "12", "123") == ["G01", "G12", "G123"]
    assert one(spark, text.secret(v), "sk-1234567890abcd", "short", "") == ["sk-12345...abcd", "***", ""]


def test_labels(spark):
    assert len(labels.dictionary()) == 354 and len(labels.fields()) == 29
    got = one(spark, labels.field_of(F.col("v")), "Net Weight (kg)", "PESO NETTO (KG) :", "N.W. (Kgs)", " Order  No. ", "رقم الحاوية", "Réf.", "unknown", "Qty (Ctns)", "Port d'Embarquement", "تاريخ الشحن")
    assert got == ["net_kg", "net_kg", "net_kg", "order_no", "container_no", "reference", None, "cartons", "pol", "ship_date"]
    assert labels.table(spark, {"Bestellnr": "order_no"}).where("label = 'bestellnr'").first()["field"] == "order_no"


def test_doc_types(spark):
    titles = {"COMMERCIAL INVOICE": "commercial_invoice", "P A C K I N G   L I S T": "packing_list", "Bill of Lading": "bill_of_lading", "PRO FORMA": "proforma_invoice", "Fattura n. 3": "commercial_invoice", "Shipment Confirmation of packing list": "confirmation", "قائمة التعبئة": "packing_list", "Facture": "commercial_invoice", "": "unknown"}
    got = one(spark, F.concat_ws("|", ex.doc_type(F.col("v"))["type"], ex.doc_type(F.col("v"))["confidence"].cast("string")), *titles, "x" * 600 + " packing list")
    assert got == [f"{t}|{'0.0' if t == 'unknown' else '0.9'}" for t in titles.values()] + ["packing_list|0.6"]


INVOICE = ("COMMERCIAL INVOICE\nTotal Net Weight: 47,634.83 kg\nTotal Gross Weight: 50,829.00 kg\nTotal Cartons: 4967\n", [
    [["Invoice No", "INV-1"], ["Date", "2024-01-02"], ["Order No", "ORD-2024-1"], ["Reference", "REF/HK/1"], ["Buyer", "B"], ["Currency", "EUR"]],
    [["Description", "Pack", "Units", "Unit Price", "Cartons", "Amount"], ["Spaghetti", "20x500", "", "2.50", "1,000", ""], ["Penne", "", "12", "3,00", "10", "30.00"], ["TOTAL", "", "", "", "", ""]],
])
BL = ("BILL OF LADING", [
    [["Shipper", "Acme Co.\nRoad 1"], ["Consignee", "Beta LLC,"], ["B/L No", "BL185831"], ["Vessel / Voyage", "JOHNSON STAR / 875E"], ["Container / Type", "WSHZ2980815  40'HC"], ["Seal No", "S1"], ["Port of Loading", "Genoa"], ["Port of Discharge", "Jeddah"], ["Order No", "ORD-2024-1"]],
    [["Marks & Nos", "No. of Packages", "Description", "Gross Weight"], ["L1", "1119 CTNS", "Spaghetti", "7.000,50"], ["L2", "10", "Penne", "80"], ["Total", "1129", "", "7.080,50"]],
])
LEGACY = ("      P A C K I N G   L I S T\nN. Ordine     : ORD-2024-33562        REF      : REF/HK/5919-H\nPorto di carico : Genova      Porto di scarico : Jeddah\n"
          "LOT         Description            No. of PkgsPeso Neto kg   Peso Bruto kg\n--------------------\n"
          "L1234A      Spaghetti No.5         1,000      6.402,00       7000.00\nL1235B      Penne                  119        500            600\nM0001C      Fusilli                1          1.5            2\n"
          "TOTAL                              1120       6903.5         7602\n", [])  # fmt: skip
CONFIRMATION = ("SHIPMENT CONFIRMATION\nWe confirm order ORD-2024-33562 (reference REF/HK/5919-H) from Acme Foods to Beta Trading, under bill of lading BL185831, container WSHZ2980815, vessel JOHNSON STAR voyage 875E.\nTotal: 4967 cartons, net 47,634.83 kg, gross 50,829.00 kg.", [])


def raw(spark, *docs):
    rows = [(f"d{i}", f"/c/S0{i}.docx", "docx", t, tables, i) for i, (t, tables) in enumerate(docs)]
    return spark.createDataFrame(rows, schema.RAW)


def test_extract(spark):
    docs = raw(spark, INVOICE, BL, LEGACY, CONFIRMATION, ("", []), (None, None))
    out = ex.extract(docs)
    assert out.schema.simpleString() == spark.createDataFrame([], schema.CANONICAL).schema.simpleString()
    invoice, bl, legacy, confirmed, empty, null = (r.asDict(recursive=True) for r in out.orderBy("doc_ord").collect())
    assert invoice["doc_type"] == "commercial_invoice" and invoice["identifiers"]["order_no"] == "ORD-2024-1"
    assert [(i["description"], i["cartons"], i["unit_price"], i["amount"], i["units"]) for i in invoice["line_items"]] == [("Spaghetti", 1000, 2.5, 2500.0, None), ("Penne", 10, 3.0, 30.0, 12)]
    assert invoice["totals"] == {"cartons": 4967, "net_kg": 47634.83, "gross_kg": 50829.0, "value": 2530.0, "currency": "EUR"}
    assert invoice["logistics"]["ship_date"] == "2024-01-02" and invoice["raw_field_labels"]["invoice_no"] == "Invoice No"
    assert bl["parties"] == {"shipper": "Acme Co", "consignee": "Beta LLC"} and bl["logistics"]["vessel"] == "JOHNSON STAR" and bl["logistics"]["voyage"] == "875E"
    assert bl["identifiers"]["container_no"] == "WSHZ2980815" and bl["totals"]["cartons"] == 1129 and bl["totals"]["gross_kg"] == 7080.5
    assert [(i["lot"], i["cartons"], i["gross_kg"]) for i in bl["line_items"]] == [("L1", 1119, 7000.5), ("L2", 10, 80.0)] and bl["extraction_confidence"] == 1.0
    assert legacy["doc_type"] == "packing_list" and legacy["identifiers"]["order_no"] == "ORD-2024-33562" and legacy["identifiers"]["reference"] == "REF/HK/5919-H"
    assert (legacy["logistics"]["pol"], legacy["logistics"]["pod"]) == ("Genova", "Jeddah")
    assert [(i["lot"], i["description"], i["cartons"], i["net_kg"], i["gross_kg"]) for i in legacy["line_items"]] == [("L1234A", "Spaghetti No.5", 1000, 6402.0, 7000.0), ("L1235B", "Penne", 119, 500.0, 600.0), ("M0001C", "Fusilli", 1, 1.5, 2.0)]
    assert (legacy["totals"]["cartons"], legacy["totals"]["net_kg"], legacy["totals"]["gross_kg"]) == (1120, 6903.5, 7602.0)
    assert confirmed["doc_type"] == "confirmation" and confirmed["identifiers"] == {"order_no": "ORD-2024-33562", "bl_no": "BL185831", "reference": "REF/HK/5919-H", "container_no": "WSHZ2980815", "seal_no": None}
    assert (confirmed["parties"]["shipper"], confirmed["parties"]["consignee"]) == ("Acme Foods", "Beta Trading")
    assert (confirmed["logistics"]["vessel"], confirmed["logistics"]["voyage"]) == ("JOHNSON STAR", "875E")
    assert (confirmed["totals"]["cartons"], confirmed["totals"]["net_kg"], confirmed["totals"]["gross_kg"]) == (4967, 47634.83, 50829.0)
    for r in (empty, null):
        assert r["doc_type"] == "unknown" and r["extraction_confidence"] == 0.0 and r["line_items"] == []


def test_header_choice_and_labels(spark):
    tables = [[["Order No", "X", "Date", "Y"], ["Currency", "EUR", "Vessel", "Z"], ["Description", "Cartons", "Net Wt"], ["Pasta", "3", "4,5"], ["Totale", "3", "4,5"]]]
    docs = raw(spark, ("Bestellnummer: 7\nOrder No: 8", tables))
    got = ex.extract(docs).first()
    assert [i["description"] for i in got["line_items"]] == ["Pasta"] and got["totals"]["net_kg"] == 4.5
    missing = ex.unresolved_labels(docs)
    assert {r["label"] for r in missing.collect()} == {"Bestellnummer", "X", "Y"}
    learned = ex.resolve_labels(missing, lambda names: {n: "order_no" if n == "Bestellnummer" else "nonsense" for n in names})
    assert learned == {"Bestellnummer": "order_no"}
    assert ex.extract(raw(spark, ("Bestellnummer: 7", [])), extra_labels=learned).first()["identifiers"]["order_no"] == "7"
