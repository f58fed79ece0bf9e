"""A corpus of shipping documents made from order tables, with planted errors.

Each order gives a bill of lading, a packing list and a commercial invoice. What is altered is a
function of the order key, so that truth needs no second table: on every 17th order the invoice
has another order number, on every 23rd the packing list a carton too many, on every 31st the
bill another net weight on its first item. Every 97th order also gives a stray confirmation
whose order number has a typing error and which has no other identifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import schema

KINDS = ("bill_of_lading", "packing_list", "commercial_invoice", "confirmation")
BAD_ORDER, BAD_CARTONS, BAD_WEIGHT, STRAY = 17, 23, 31, 97


def _key(width: int = 9) -> Column:
    return F.lpad(F.col("o_orderkey").cast("string"), width, "0")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items: (o_orderkey, o_custkey, ship_date, items sorted by line).

    Items pass the shuffle as they stand in the table, and get their texts after it.
    """
    given = ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_suppkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct(*given)).alias("given"))
    # the smaller side is held as a table of hashes, so that the collected items are not sorted
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ship_date"))
    item = lambda g: F.struct(
        g["l_linenumber"].alias("line"), F.concat(F.lit("L"), F.lpad(g["l_partkey"].cast("string"), 6, "0"), F.lit("-"), g["l_linenumber"].cast("string")).alias("lot"),
        F.concat(F.lit("Part "), g["l_partkey"].cast("string")).alias("description"), g["l_quantity"].cast("bigint").alias("cartons"),
        F.round(g["l_quantity"] * 2.5, 2).alias("net_kg"), F.round(g["l_quantity"] * 3, 2).alias("gross_kg"),
        (F.floor(g["l_extendedprice"] * 100 / g["l_quantity"]) / 100).alias("unit_price"), g["l_extendedprice"].alias("amount"), g["l_suppkey"].alias("supplier"),
    )
    both = orders.hint("shuffle_hash").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", "o_custkey", "ship_date", F.array_sort(F.transform("given", item)).alias("items"))


def _orders(spark: SparkSession, sf_dir: str, shown: Callable[[Column], Column]) -> DataFrame:
    """What all documents of an order state, worked out once for all of them: items as ``shown`` has them, the first with another weight where one is planted, sums."""
    total = lambda f, kind="double": F.aggregate("items", F.lit(0).cast(kind), lambda a, i: a + i[f])
    first = F.get("items", F.lit(0))
    return shipments(spark, sf_dir).select(
        "o_orderkey", "ship_date", F.concat(F.lit("Supplier "), first["supplier"].cast("string")).alias("shipper"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("consignee"),
        F.transform("items", shown).alias("items"), F.when(F.col("o_orderkey") % BAD_WEIGHT == 0, F.transform(F.slice("items", 1, 1), lambda i: shown(i.withField("net_kg", i["net_kg"] + 10)))).alias("first"),
        total("cartons", "bigint").alias("cartons"), F.round(total("net_kg"), 2).alias("net_kg"), F.round(total("gross_kg"), 2).alias("gross_kg"), F.round(total("amount"), 2).alias("value"),
    )


def documents(orders: DataFrame) -> DataFrame:
    """What the documents state: the columns of ``_orders``, kind_no, and what is stated by kind."""
    kinds = F.when(F.col("o_orderkey") % STRAY == 0, F.array(*map(F.lit, range(4)))).otherwise(F.array(*map(F.lit, range(3))))
    planted = lambda every, kind: (F.col("o_orderkey") % every == 0) & (F.col("kind_no") == kind)
    order_no = F.when(planted(BAD_ORDER, 2), F.concat(F.lit("ORD-"), _key(8), F.lit("X"))).when(F.col("kind_no") == 3, F.concat(F.lit("ORD-"), _key(), F.lit("Z"))).otherwise(F.concat(F.lit("ORD-"), _key()))
    items = F.when(F.col("kind_no") == 3, F.slice("items", 1, 0)).when(planted(BAD_WEIGHT, 0), F.concat("first", F.slice("items", 2, F.size("items")))).otherwise(F.col("items"))
    own = lambda c: F.when(F.col("kind_no") < 3, c)
    return orders.select("*", F.explode(kinds).alias("kind_no")).withColumns({
        "order_no": order_no, "bl_no": own(F.concat(F.lit("BL"), _key())), "container_no": own(F.concat(F.lit("CONT"), _key())), "items": items,
        "cartons": F.col("cartons") + F.when(planted(BAD_CARTONS, 1), 1).otherwise(0),
    })


def _names() -> list[Column]:
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("kind_no"))
    path = F.concat(F.lit("/corpus/S"), _key(), F.lit("_"), kind, F.when(F.col("kind_no") == 2, ".xlsx").otherwise(".docx"))
    return [F.concat(_key(12), F.lit("-"), F.col("kind_no").cast("string")).alias("doc_id"), path.alias("source_path"), kind.alias("doc_type"), F.when(F.col("kind_no") == 2, "xlsx").otherwise("docx").alias("source_format")]


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CANONICAL documents, as extraction would give them."""
    doc_id, path, kind, form = _names()
    item = lambda i: F.struct(i["description"].alias("description"), i["lot"].alias("lot"), i["cartons"].alias("cartons"), i["net_kg"].alias("net_kg"), i["gross_kg"].alias("gross_kg"), i["unit_price"].alias("unit_price"), F.lit(None).cast("bigint").alias("units"), i["amount"].alias("amount"))
    null = lambda t="string": F.lit(None).cast(t)
    return documents(_orders(spark, sf_dir, item)).select(
        doc_id, path, kind, form,
        F.struct("order_no", "bl_no", null().alias("reference"), "container_no", null().alias("seal_no")).alias("identifiers"),
        F.struct("shipper", "consignee").alias("parties"),
        F.struct(null().alias("vessel"), null().alias("voyage"), null().alias("pol"), null().alias("pod"), "ship_date").alias("logistics"),
        F.col("items").alias("line_items"), F.struct("cartons", "net_kg", "gross_kg", "value", F.lit("EUR").alias("currency")).alias("totals"),
        F.lit(1.0).alias("extraction_confidence"), null("map<string,string>").alias("raw_field_labels"), (F.col("o_orderkey") * 4 + F.col("kind_no")).alias("doc_ord"),
    )


#: Labels by language, chosen by the order key: order, bill, container, shipper, consignee, date, currency.
LANGUAGES = (
    ("Order No", "B/L No", "Container No", "Shipper", "Consignee", "Ship Date", "Currency"),
    ("N. Ordine", "Polizza di carico", "Contenitore", "Mittente", "Destinatario", "Data di spedizione", "Valuta"),
    ("N° de commande", "Connaissement", "Container", "Expéditeur", "Destinataire", "Date d'expédition", "Devise"),
)
HEADERS = (
    ("Lot No", "Description", "Cartons", "Net Weight (kg)", "Gross Weight (kg)", "Unit Price", "Amount"),
    ("Lotto", "Descrizione", "Colli", "Peso Netto (kg)", "Peso Lordo (kg)", "Prezzo Unitario", "Importo"),
    ("Numéro de lot", "Désignation", "Nombre de cartons", "Poids net (kg)", "Poids brut (kg)", "Prix unitaire", "Montant"),
)
TITLES = ("BILL OF LADING", "P A C K I N G   L I S T", "COMMERCIAL INVOICE", "SHIPMENT CONFIRMATION")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW documents: the same statements, rendered as tables in three languages and number formats."""
    doc_id, path, _, form = _names()
    pick = lambda choices: F.get(F.array(*[F.array(*map(F.lit, c)) for c in choices]), (F.col("o_orderkey") % 3).cast("int"))
    plain = lambda c: F.format_number(c, 2)
    european = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    spaced = lambda c: F.replace(F.format_number(c, 2), F.lit(","), F.lit(" "))
    shown = lambda c: F.when(F.col("o_orderkey") % 3 == 0, plain(c)).when(F.col("o_orderkey") % 3 == 1, european(c)).otherwise(spaced(c))
    label = lambda i: F.get(pick(LANGUAGES), F.lit(i))
    values = ["order_no", "bl_no", "container_no", "shipper", "consignee", "ship_date", F.lit("EUR")]
    pairs = F.filter(F.array(*[F.array(label(i), F.col(v) if isinstance(v, str) else v) for i, v in enumerate(values)]), lambda p: F.get(p, F.lit(1)).isNotNull())
    row = lambda i: F.array(i["lot"], i["description"], F.concat(i["cartons"].cast("string"), F.lit(" CTNS")), shown(i["net_kg"]), shown(i["gross_kg"]), shown(i["unit_price"]), shown(i["amount"]))
    total = F.array(F.lit("TOTAL"), F.lit(""), F.col("cartons").cast("string"), "net_shown", "gross_shown", F.lit(""), "value_shown")
    body = F.concat(F.array(pick(HEADERS)), "items", F.array(total))
    tables = F.when(F.col("kind_no") < 3, F.array(pairs, body)).otherwise(F.array().cast("array<array<array<string>>>"))
    said = F.concat(F.lit("\nWe confirm order "), "order_no", F.lit(" from "), "shipper", F.lit(" to "), "consignee", F.lit(".\nTotal: "), F.col("cartons").cast("string"), F.lit(" cartons, net "), plain(F.col("net_kg")), F.lit(" kg, gross "), plain(F.col("gross_kg")), F.lit(" kg."))
    title = F.get(F.array(*map(F.lit, TITLES)), F.col("kind_no"))
    text = F.concat(title, F.when(F.col("kind_no") == 3, said).otherwise(""))
    orders = _orders(spark, sf_dir, row).withColumns({"net_shown": shown(F.col("net_kg")), "gross_shown": shown(F.col("gross_kg")), "value_shown": shown(F.col("value"))})
    return documents(orders).select(doc_id, path, form, text.alias("text"), tables.alias("tables"), (F.col("o_orderkey") * 4 + F.col("kind_no")).alias("doc_ord"))


def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANSWER_KEY of the corpus: one row an order."""
    there = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").join(there, "o_orderkey", "left_semi")
    bad = lambda every: F.col("o_orderkey") % every == 0
    where = F.when(bad(BAD_ORDER), "invoice").when(bad(BAD_CARTONS), "packing_list").when(bad(BAD_WEIGHT), "bill_of_lading")
    detail = F.when(bad(BAD_ORDER), "order no differs").when(bad(BAD_CARTONS), "cartons differ").when(bad(BAD_WEIGHT), "net_kg differs")
    return orders.select(
        F.col("o_orderkey").alias("shipment"), F.concat(F.lit("ORD-"), _key()).alias("order_no"), F.concat(F.lit("BL"), _key()).alias("bl_no"), F.concat(F.lit("CONT"), _key()).alias("container"),
        detail.isNotNull().alias("has_planted_discrepancy"), where.alias("discrepancy_in_doc_type"), F.when(detail.isNotNull(), F.array(detail)).otherwise(F.array().cast("array<string>")).alias("discrepancy_detail"),
    )


def with_error(docs: DataFrame, every: int = 7, id_col: str = "doc_ord") -> DataFrame:
    """Error injection: one of four alterations on every ``every``-th document, told by its number.

    The order number's last digit, the container number, an item's net weight (x 1.1) or its cartons (+ 3).
    """
    turn = F.when(F.col(id_col) % every == 0, F.floor(F.col(id_col) / every) % 4)
    ids = F.col("identifiers")
    digit = ((F.right(ids["order_no"], F.lit(1)).try_cast("int") + 1) % 10).cast("string")
    bad_order = F.concat(F.expr("substring(identifiers.order_no, 1, length(identifiers.order_no) - 1)"), F.coalesce(digit, F.lit("9")))
    ids = ids.withField("order_no", F.when(turn == 0, bad_order).otherwise(ids["order_no"])).withField("container_no", F.when(turn == 1, F.concat(ids["container_no"], F.lit("9"))).otherwise(ids["container_no"]))

    def item(i: Column, n: Column) -> Column:
        weight = F.when((turn == 2) & (n == 0), F.round(i["net_kg"] * 1.1, 2)).otherwise(i["net_kg"])
        return i.withField("net_kg", weight).withField("cartons", F.when((turn == 3) & (n == 0), i["cartons"] + 3).otherwise(i["cartons"]))

    return docs.withColumns({"identifiers": ids, "line_items": F.transform("line_items", item), "injected": turn.cast("int")})


def check(docs: DataFrame) -> None:
    """Raise if ``docs`` lacks a column of RAW."""
    missing = [c.split()[0] for c in schema.RAW.split(", ") if c.split()[0] not in docs.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
