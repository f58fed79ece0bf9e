"""Named queries over the driver's tables, one or more for each group of operators, and their SQL.

Shipping documents are rendered from orders and line items (``sources.corpus``). The SQL states
what must come out from the tables themselves: it votes, parses and renders nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import labels, text
from tallymark.operators import extract as ex
from tallymark.operators import feedback as fb
from tallymark.operators import match as ma
from tallymark.operators import verify as ve
from tallymark.plans import report as re_
from tallymark.plans import score as sc
from tallymark.sources import corpus
from tallymark.streaming.groups import Groups
from tallymark.tables import fresh_path, numbered, settle

# Items of one order may share line and lot: the first is told by all their columns, as the corpus sorts them.
# Facts of the corpus in SQL: orders, items, totals of orders, and which errors are planted where.
BASE = """
WITH li AS (
  SELECT l_orderkey AS k, l_linenumber AS line, 'L' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || '-' || l_linenumber AS lot, 'Part ' || l_partkey AS description,
         CAST(l_quantity AS BIGINT) AS cartons, round(l_quantity * 2.5, 2) AS net_kg, round(l_quantity * 3, 2) AS gross_kg,
         floor(l_extendedprice * 100 / l_quantity) / 100 AS unit_price, l_extendedprice AS amount, l_suppkey AS supplier
  FROM lineitem),
o AS (
  SELECT o_orderkey AS k, min(o_custkey) AS cust, min(strftime(o_orderdate, '%Y-%m-%d')) AS ship_date, 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_no,
         'BL' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS bl_no, 'CONT' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS container_no, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '-' AS doc,
         CAST(sum(cartons) AS BIGINT) AS cartons, round(sum(net_kg), 2) AS net_kg, round(sum(gross_kg), 2) AS gross_kg, round(sum(amount), 2) AS value,
         arg_min(li.supplier, (line, lot, description, li.cartons, li.net_kg, li.gross_kg, li.unit_price, li.amount, li.supplier)) AS supplier, arg_min(lot, (line, lot, description, li.cartons, li.net_kg, li.gross_kg, li.unit_price, li.amount, li.supplier)) AS lot, arg_min(li.net_kg, (line, lot, description, li.cartons, li.net_kg, li.gross_kg, li.unit_price, li.amount, li.supplier)) AS first_net
  FROM orders JOIN li ON o_orderkey = li.k GROUP BY o_orderkey)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three regular documents of each order, grouped by it."""
    docs = corpus.canonical(spark, sf_dir).where("doc_type <> 'confirmation'")
    return settle(docs.withColumn("group_id", F.concat(F.lit("O"), F.floor(F.col("doc_ord") / 4).cast("string"))), "members")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on all fields of all shipments: verdicts and findings, counted."""
    members = _members(spark, sf_dir)
    found = settle(ve.findings(members), "findings")
    return ve.verdicts(found, members).groupBy("verdict").agg(F.count("*").alias("n_groups"), F.sum("n_findings").cast("bigint").alias("n_findings"), F.sum("n_docs").cast("bigint").alias("n_docs"))


def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ve.findings(_members(spark, sf_dir))
    return found.select("group_id", "field", "doc_a", "value_a", "doc_b", "value_b", "severity", "message")


def verify_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ve.findings(_members(spark, sf_dir), tolerance=10.5)
    return found.groupBy("severity", F.regexp_replace("field", r"\[.*\]", "").alias("field")).agg(F.count("*").alias("n"))


def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    out = ve.verdicts(settle(ve.findings(members), "findings"), members)
    return out.select("group_id", "verdict", F.array_join("suspect_doc_ids", ",").alias("suspects"), "n_docs", "n_findings")


def verify_single_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that only one document has: the second document of each order lacks its first item."""
    members = _members(spark, sf_dir)
    cut = F.when(F.col("doc_type") != "bill_of_lading", F.filter("line_items", lambda i, n: n > 0)).otherwise(F.col("line_items"))
    found = ve.findings(members.withColumn("line_items", cut))
    return found.where("severity = 'low'").select("group_id", "field", "doc_a", "doc_b", "value_a", "value_b", "message")


def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.canonical(spark, sf_dir).select("doc_id", "doc_ord", "identifiers")
    out = ma.match(docs)
    return out.select("group_id", "group_rank", "doc_id", "certainty", "absorbed")


def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.canonical(spark, sf_dir).select("doc_id", "doc_ord", "identifiers")
    out = ma.match(docs, fuzzy=False)
    return out.groupBy("certainty").agg(F.count("*").alias("n_docs"), F.countDistinct("group_id").alias("n_groups"))


def match_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that arrive in three batches, one of them twice."""
    docs = settle(corpus.canonical(spark, sf_dir).select("doc_id", "doc_ord", "identifiers"), "arriving")
    kept = Groups(spark, fresh_path(spark, "groups"))
    for number in (0, 1, 1, 2):
        kept.absorb(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == number), number)
    return kept.groups(docs).select("group_id", "group_rank", "doc_id", "certainty", "absorbed")


def match_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of 30 signs: two documents an order, and for some a third whose number is damaged a little, or too much."""
    key = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    signs = F.substring(F.upper(F.md5(key)), 1, 30)
    part = lambda a, n: F.substring(signs, a, n)
    near = F.concat(F.lit("Q"), part(1, 4), part(6, 6), F.lit("Z"), part(13, 18))  # one more, one less, another
    far = F.concat(F.lit("QQQQQQQQQQ"), part(11, 20))
    kinds = F.when(F.col("o_orderkey") % 64 == 1, F.array(signs, signs, near)).when(F.col("o_orderkey") % 64 == 2, F.array(signs, signs, far)).otherwise(F.array(signs, signs))
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.posexplode(kinds).alias("kind", "bl_no"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    docs = docs.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.col("kind").cast("string")).alias("doc_id"), (F.col("o_orderkey") * 4 + F.col("kind")).alias("doc_ord"),
                       F.struct(none("order_no"), "bl_no", none("reference"), none("container_no"), none("seal_no")).alias("identifiers"))
    out = settle(ma.match(docs), "match-long")
    first = out.groupBy("group_id").agg(F.min_by("doc_id", "doc_ord").alias("first"))
    return out.join(first, "group_id").select("doc_id", "first", "certainty", "absorbed")


def extract_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ex.extract(corpus.raw(spark, sf_dir))
    return out.select("doc_id", "doc_type", "identifiers.order_no", "identifiers.bl_no", "identifiers.container_no", "parties.shipper", "parties.consignee", "logistics.ship_date", "totals.currency", "extraction_confidence")


def extract_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ex.extract(corpus.raw(spark, sf_dir))
    return out.select("doc_id", "totals.cartons", "totals.net_kg", "totals.gross_kg", "totals.value")


def extract_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ex.extract(corpus.raw(spark, sf_dir)).select("doc_id", F.posexplode("line_items").alias("idx", "i"))
    return out.select("doc_id", "idx", "i.lot", "i.description", "i.cartons", "i.net_kg", "i.gross_kg", "i.unit_price", "i.amount")


def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents all the way: extract, match, verify, count."""
    docs = settle(ex.extract(corpus.raw(spark, sf_dir)), "canonical")
    # of what was extracted, findings and verdicts read these columns only, so that no others pass the shuffle
    stated = docs.select("doc_id", "doc_ord", "identifiers", "totals", "parties", "logistics", "line_items")
    members = settle(stated.join(ma.match(docs).select("group_id", "doc_ord"), "doc_ord"), "members")
    found = settle(ve.findings(members), "findings")
    return re_.summary(ve.verdicts(found, members))


def corpus_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected errors, told by comparing the altered documents with the originals."""
    docs = corpus.canonical(spark, sf_dir).where("doc_type <> 'confirmation'")
    both = corpus.with_error(docs.withColumn("was", F.struct("identifiers", "line_items")))
    first = lambda c: F.get(F.col(c), F.lit(0))
    return both.groupBy(F.coalesce("injected", F.lit(-1)).alias("injected")).agg(
        F.count("*").alias("n"), F.count_if(F.col("identifiers.order_no") != F.col("was.identifiers.order_no")).alias("orders"),
        F.count_if(F.col("identifiers.container_no") != F.col("was.identifiers.container_no")).alias("containers"),
        F.count_if(first("line_items")["net_kg"] != first("was.line_items")["net_kg"]).alias("weights"), F.count_if(first("line_items")["cartons"] != first("was.line_items")["cartons"]).alias("cartons"),
    )


def report_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    found = settle(ve.findings(members), "findings")
    return re_.consensus(members, ve.suspects(found, members))


def report_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return re_.corrections(re_.failed(members, settle(ve.findings(members), "findings")))


def report_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports of failed groups: findings and the sentence that sums them up."""
    members = _members(spark, sf_dir)
    results = settle(re_.failed(members, settle(ve.findings(members), "findings")), "results")
    return re_.markdown(results.where("verdict = 'FAIL'"))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    out = re_.markdown(re_.results(members, settle(ve.findings(members), "findings")))
    return out.select("group_id", F.get(F.split("text", "\n"), F.lit(2)).alias("verdict_line"), F.get(F.split("text", "\n"), F.lit(4)).alias("order_line"), (F.size(F.split("text", r"\n- \*\*")) - 1).alias("documents"))


def _scored(spark: SparkSession, sf_dir: str):
    members = _members(spark, sf_dir)
    found = settle(ve.findings(members), "findings")
    return members, found, settle(ve.verdicts(found, members), "verdicts"), settle(sc.shipments(members), "numbers"), settle(corpus.answer_key(spark, sf_dir), "key")


def score_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, verdicts, numbers, key = _scored(spark, sf_dir)
    return sc.confusion(key, verdicts, numbers)


def score_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion table in the order in which it is exported, with each row's place."""
    _, _, verdicts, numbers, key = _scored(spark, sf_dir)
    return numbered(sc.confusion(key, verdicts, numbers), ["shipment"], "place").select("place", "shipment", "expected_verdict", "predicted_verdict")


def score_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, found, verdicts, numbers, key = _scored(spark, sf_dir)
    return sc.localization(key, found, members, verdicts, numbers).select("shipment", "expected_doc_type", "expected_field", "correct")


def score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, found, verdicts, numbers, key = _scored(spark, sf_dir)
    return sc.scorecard(sc.confusion(key, verdicts, numbers), sc.localization(key, found, members, verdicts, numbers))


def feedback_rows(events: DataFrame) -> DataFrame:
    """Reviews made from the events: each type stands for a verdict, each user for a field and a document type."""
    kinds = F.array(*map(F.lit, ("identifiers.order_no", "totals.net_kg", "totals.cartons", "parties.shipper", "logistics.vessel")))
    types = F.array(*map(F.lit, ("commercial_invoice", "packing_list", "bill_of_lading", "")))
    verdict = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "corrected").otherwise("confirmed")
    null = F.lit("")
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("shipment_id"),
        F.get(kinds, (F.col("user_id") % 5).cast("int")).alias("field"), verdict.alias("verdict"), F.col("props").alias("notes"), null.alias("pipeline_verdict"), null.alias("severity"), null.alias("provider"),
        F.get(types, (F.col("event_id") % 4).cast("int")).alias("doc_type"),
    )


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feedback_rows(_table(spark, sf_dir, "events"))
    return fb.recent(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), 30)


def feedback_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.overall(_recent(spark, sf_dir))


def feedback_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.error_rate(_recent(spark, sf_dir), "field")


def feedback_by_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.error_rate(_recent(spark, sf_dir), "doc_type")


def feedback_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.trend(_recent(spark, sf_dir))


def feedback_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.boosts(feedback_rows(_table(spark, sf_dir, "events")))


def feedback_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.training_text(feedback_rows(_table(spark, sf_dir, "events"))).groupBy("value").agg(F.count("*").alias("n"))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("hash"))


def text_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", text.identifier(F.concat(F.lit(" "), "c_name", F.lit("/a-1."))).alias("key"))


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices rendered four ways and read back."""
    n = F.col("l_extendedprice")
    plain = F.format_number(n, 2)
    ways = [plain, F.translate(plain, ",.", ".,"), F.concat(F.lit("EUR "), F.replace(plain, F.lit(","), F.lit(" ")), F.lit(" kg")), F.concat(F.lit("€"), F.replace(plain, F.lit(","), F.lit("")))]
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[text.number(w).alias(f"n{i}") for i, w in enumerate(ways)])


def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.table(spark).groupBy("field").agg(F.count("*").alias("n"))


def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier on running text: documents with a title put before them."""
    titles = F.array(*map(F.lit, ("Bill of Lading\n", "PACKING  LIST\n", "Fattura n. 7\n", "no title\n")))
    typed = ex.doc_type(F.concat(F.get(titles, (F.col("doc_id") % 4).cast("int")), F.coalesce("text", F.lit(""))))
    return _table(spark, sf_dir, "documents").select("doc_id", typed.alias("t")).select("doc_id", "t.type", "t.confidence")


QUERIES = {
    f.__name__: f
    for f in (
        flagship, verify_findings, verify_tolerance, verify_verdicts, verify_single_items, match_groups, match_exact, match_arriving, match_long, extract_headers, extract_totals, extract_items,
        pipeline_summary, corpus_errors, report_consensus, report_corrections, report_failed, report_markdown, score_confusion, score_sorted, score_localization, score_card, feedback_overall, feedback_by_field,
        feedback_by_doc_type, feedback_trend, feedback_boosts, feedback_training, text_hashes, text_identifiers, text_numbers, label_fields, doc_types,
    )
}

# The findings that the planted errors must give.
PLANTED = BASE + """,
f AS (
  SELECT k, 'identifiers.order_no' AS field, 0 AS a, order_no AS value_a, 2 AS b, 'ORD-' || lpad(CAST(k AS VARCHAR), 8, '0') || 'X' AS value_b FROM o WHERE k % 17 = 0
  UNION ALL SELECT k, 'totals.cartons', 0, CAST(cartons AS VARCHAR), 1, CAST(cartons + 1 AS VARCHAR) FROM o WHERE k % 23 = 0
  UNION ALL SELECT k, 'line_items[lot=' || lot || '].net_kg', 1, CAST(first_net AS VARCHAR), 0, CAST(first_net + 10 AS VARCHAR) FROM o WHERE k % 31 = 0)
"""
EVENTS = """
WITH r AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, ts, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'corrected' ELSE 'confirmed' END AS verdict,
         ['identifiers.order_no', 'totals.net_kg', 'totals.cartons', 'parties.shipper', 'logistics.vessel'][user_id % 5 + 1] AS field,
         ['commercial_invoice', 'packing_list', 'bill_of_lading', ''][event_id % 4 + 1] AS doc_type
  FROM events),
w AS (SELECT * FROM r WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-01 00:00:00')
"""
# printf rounds the binary value, ties to even; round() does not
_RATE = "count(*) AS n, CAST(printf('%.3f', count(*) FILTER (WHERE verdict <> 'confirmed') / count(*)) AS DOUBLE) AS error_rate"

ORACLE_SQL = {
    "flagship": BASE + """,
n AS (SELECT k, (k % 17 = 0)::INT + (k % 23 = 0)::INT + (k % 31 = 0)::INT AS c FROM o)
SELECT CASE WHEN c > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n_groups, CAST(sum(c) AS BIGINT) AS n_findings, CAST(3 * count(*) AS BIGINT) AS n_docs FROM n GROUP BY 1""",
    "verify_findings": PLANTED + """
SELECT 'O' || k AS group_id, field, doc || a AS doc_a, value_a, doc || b AS doc_b, value_b, 'high' AS severity,
       field || ' mismatch: 2 of 3 docs show ' || value_a || ', doc shows ' || value_b AS message
FROM f JOIN o USING (k)""",
    "verify_tolerance": PLANTED + """
SELECT 'high' AS severity, field, count(*) AS n FROM f WHERE field IN ('identifiers.order_no', 'totals.cartons') GROUP BY field""",
    "verify_verdicts": PLANTED + """
, s AS (SELECT k, string_agg(DISTINCT doc || b, ',' ORDER BY doc || b) AS suspects, count(*) AS c FROM f JOIN o USING (k) GROUP BY k)
SELECT 'O' || o.k AS group_id, CASE WHEN c > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, coalesce(suspects, '') AS suspects, CAST(3 AS BIGINT) AS n_docs, coalesce(c, 0) AS n_findings
FROM o LEFT JOIN s ON o.k = s.k""",
    "verify_single_items": BASE + """,
i AS (SELECT k, lot, description, row_number() OVER (PARTITION BY k ORDER BY line, lot, description, cartons, net_kg, gross_kg, unit_price, amount, supplier) - 1 AS idx FROM li),
d AS (SELECT o.k, o.doc || kind AS doc, kind, i.lot, description, idx FROM o JOIN i ON o.k = i.k, (SELECT unnest([0, 1, 2]) AS kind) WHERE kind = 0 OR idx > 0),
l AS (SELECT *, idx = max(idx) OVER (PARTITION BY k, lot, kind) AS last, min(kind) OVER (PARTITION BY k, lot) <> max(kind) OVER (PARTITION BY k, lot) AS several FROM d),
r AS (SELECT *, idx = max(idx) OVER (PARTITION BY k, description, kind) AS last_, min(kind) OVER (PARTITION BY k, description) <> max(kind) OVER (PARTITION BY k, description) AS several_ FROM l WHERE NOT (last AND several)),
s AS (SELECT k, doc, 'lot=' || lot AS path, lot AS label FROM l WHERE last AND NOT several UNION ALL SELECT k, doc, 'desc=' || lower(description), description FROM r WHERE last_ AND NOT several_)
SELECT 'O' || k AS group_id, 'line_items[' || path || ']' AS field, doc AS doc_a, doc AS doc_b, label AS value_a, 'not present in other documents' AS value_b, 'Line item ''' || label || ''' only found in one document' AS message FROM s""",
    "match_groups": BASE + """,
d AS (SELECT k, row_number() OVER (ORDER BY k) AS group_rank, doc, unnest(CASE WHEN k % 97 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS kind FROM o)
SELECT printf('G%02d', group_rank) AS group_id, group_rank, doc || kind AS doc_id, CASE WHEN kind = 3 THEN 0.4 ELSE 1.0 END::DOUBLE AS certainty, kind = 3 AS absorbed FROM d""",
    "match_long": """
WITH d AS (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 64 IN (1, 2) THEN [0, 1, 2] ELSE [0, 1] END) AS kind FROM orders)
SELECT k || '-' || kind AS doc_id, CASE WHEN kind = 2 AND k % 64 = 2 THEN k || '-2' ELSE k || '-0' END AS first,
       CASE WHEN kind < 2 THEN 0.7 WHEN k % 64 = 1 THEN 0.4 ELSE 0.2 END::DOUBLE AS certainty, kind = 2 AND k % 64 = 1 AS absorbed
FROM d""",
    "match_exact": BASE + """
SELECT CAST(1.0 AS DOUBLE) AS certainty, CAST(3 * count(*) AS BIGINT) AS n_docs, count(*) AS n_groups FROM o
UNION ALL SELECT 0.2, count(*), count(*) FROM o WHERE k % 97 = 0""",
    "extract_headers": BASE + """,
d AS (SELECT *, unnest(CASE WHEN k % 97 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS kind FROM o)
SELECT doc || kind AS doc_id, ['bill_of_lading', 'packing_list', 'commercial_invoice', 'confirmation'][kind + 1] AS doc_type,
       CASE WHEN kind = 2 AND k % 17 = 0 THEN 'ORD-' || lpad(CAST(k AS VARCHAR), 8, '0') || 'X' WHEN kind = 3 THEN order_no || 'Z' ELSE order_no END AS order_no,
       CASE WHEN kind < 3 THEN bl_no END AS bl_no, CASE WHEN kind < 3 THEN container_no END AS container_no, 'Supplier ' || supplier AS shipper, 'Customer ' || cust AS consignee,
       CASE WHEN kind < 3 THEN ship_date END AS ship_date, CASE WHEN kind < 3 THEN 'EUR' END AS currency, CAST(1.0 AS DOUBLE) AS extraction_confidence
FROM d""",
    "extract_totals": BASE + """,
d AS (SELECT *, unnest(CASE WHEN k % 97 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS kind FROM o)
SELECT doc || kind AS doc_id, cartons + (kind = 1 AND k % 23 = 0)::BIGINT AS cartons, net_kg, gross_kg,
       CASE WHEN kind < 3 THEN value END AS value
FROM d""",
    "extract_items": BASE + """,
d AS (SELECT *, unnest([0, 1, 2]) AS kind FROM o),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY line, lot, description, cartons, amount) - 1 AS INTEGER) AS idx FROM li)
SELECT doc || kind AS doc_id, idx, i.lot, i.description, i.cartons, i.net_kg + CASE WHEN kind = 0 AND d.k % 31 = 0 AND idx = 0 THEN 10 ELSE 0 END AS net_kg, i.gross_kg, i.unit_price, i.amount
FROM d JOIN i USING (k)""",
    "pipeline_summary": BASE + """
SELECT count(*) AS shipments, count(*) FILTER (WHERE NOT (k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0 OR k % 97 = 0)) AS passed,
       count(*) FILTER (WHERE k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0 OR k % 97 = 0) AS failed FROM o""",
    "corpus_errors": BASE + """,
d AS (SELECT k * 4 + unnest([0, 1, 2]) AS n FROM o),
e AS (SELECT CASE WHEN n % 7 = 0 THEN CAST(n // 7 % 4 AS INTEGER) ELSE -1 END AS injected FROM d)
SELECT injected, count(*) AS n, count(*) FILTER (WHERE injected = 0) AS orders, count(*) FILTER (WHERE injected = 1) AS containers, count(*) FILTER (WHERE injected = 2) AS weights, count(*) FILTER (WHERE injected = 3) AS cartons
FROM e GROUP BY 1""",
    "report_consensus": BASE + """,
v AS (SELECT *, (k % 17 = 0)::INT AS s2, (k % 23 = 0)::INT AS s1, (k % 31 = 0)::INT AS s0 FROM o)
SELECT 'O' || k AS group_id, CASE WHEN s2 = 1 AND NOT (s0 = 1 AND s1 = 1) THEN order_no ELSE order_no END AS order_no, bl_no, container_no,
       CAST(cartons AS VARCHAR) AS cartons, CAST(net_kg AS VARCHAR) AS net_kg, CAST(gross_kg AS VARCHAR) AS gross_kg, CAST(value AS VARCHAR) AS value, 'EUR' AS currency FROM v""",
    "report_corrections": PLANTED + """
, c AS (SELECT k, count(DISTINCT b) AS n_suspect FROM f GROUP BY k),
t AS (
  SELECT k, 3 - n_suspect AS n, string_agg('  - ' || ['Bill Of Lading', 'Packing List', 'Commercial Invoice'][b + 1] || ' (' || replace(string_split(field, '.')[-1], '_', ' ') || '): shows "' || value_b
         || '" but should be "' || value_a || '" per the other ' || (3 - n_suspect) || CASE WHEN n_suspect = 2 THEN ' document' ELSE ' documents' END || ' in this shipment.', chr(10) ORDER BY field) AS lines,
         arg_min(a, field) AS a
  FROM f JOIN c USING (k) GROUP BY k, n_suspect)
SELECT 'O' || k AS group_id, 'Subject: Correction needed — Order ' || order_no || ' / B/L ' || bl_no || chr(10) || chr(10) || 'Dear Supplier ' || supplier || ',' || chr(10) || chr(10)
       || 'While cross-checking the documents for shipment ' || order_no || ' (B/L ' || bl_no || ', container ' || container_no || ') we found discrepancy(ies) that need correction:' || chr(10) || chr(10)
       || lines || chr(10) || chr(10) || 'Please reissue the corrected document(s) at your earliest convenience so we can clear the shipment without delay.' || chr(10) || chr(10) || 'Best regards,' || chr(10) || 'Logistics Team' AS text
FROM t JOIN o USING (k)""",
    "report_failed": PLANTED + """
, d AS (SELECT k, [{'t': 'bill_of_lading', 'e': 'docx'}, {'t': 'packing_list', 'e': 'docx'}, {'t': 'commercial_invoice', 'e': 'xlsx'}] AS kinds FROM o),
p AS (SELECT k, list_transform(kinds, lambda x: {'t': x.t, 'p': '/corpus/S' || lpad(CAST(k AS VARCHAR), 9, '0') || '_' || x.t || '.' || x.e}) AS docs FROM d),
c AS (SELECT k, 3 - count(DISTINCT b) AS n, arg_min(b, field) AS b, arg_min(field, field) AS field FROM f GROUP BY k),
t AS (SELECT f.k, string_agg('| ' || field || ' | `' || docs[b + 1].p || '` | ' || value_b || ' | ' || value_a || ' | high |', chr(10) ORDER BY field) AS lines FROM f JOIN p USING (k) GROUP BY f.k)
SELECT 'O' || k AS group_id, '# Shipment Report — O' || k || chr(10) || chr(10) || '**Verdict:** FAIL' || chr(10) || chr(10) || '**Order No:** ' || order_no || '  ' || chr(10) || '**B/L No:** ' || bl_no || '  ' || chr(10)
  || '**Container No:** ' || container_no || chr(10) || chr(10) || '**Documents:** 3' || chr(10) || chr(10) || '## Documents' || chr(10) || chr(10)
  || array_to_string(list_transform(docs, lambda x: '- **' || x.t || '** — `' || x.p || '`'), chr(10)) || chr(10) || chr(10)
  || '## Findings' || chr(10) || chr(10) || '| Field | Suspect Doc | Found Value | Expected Value | Severity |' || chr(10) || '|-------|------------|-------------|----------------|----------|' || chr(10) || lines || chr(10) || chr(10)
  || '**Summary:** Likely error: the ' || ['Bill Of Lading', 'Packing List', 'Commercial Invoice'][c.b + 1] || ' (`' || docs[c.b + 1].p || '`) — ' || replace(string_split(c.field, '.')[-1], '_', ' ')
  || ' disagrees with ' || n || CASE WHEN n = 1 THEN ' other document' ELSE ' other documents' END || ' in this shipment.' || chr(10) AS text
FROM c JOIN t USING (k) JOIN p USING (k) JOIN o USING (k)""",
    "report_markdown": PLANTED + """
SELECT 'O' || k AS group_id, '**Verdict:** ' || CASE WHEN k IN (SELECT k FROM f) THEN 'FAIL' ELSE 'PASS' END AS verdict_line, '**Order No:** ' || order_no || '  ' AS order_line, 3 AS documents FROM o""",
    "score_confusion": BASE + """
SELECT k AS shipment, p AS planted_error, CASE WHEN p THEN 'FAIL' ELSE 'PASS' END AS expected_verdict, CASE WHEN p THEN 'FAIL' ELSE 'PASS' END AS predicted_verdict, true AS correct
FROM (SELECT k, k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0 AS p FROM o)""",
    "score_sorted": BASE + """
SELECT row_number() OVER (ORDER BY k) AS place, k AS shipment, CASE WHEN p THEN 'FAIL' ELSE 'PASS' END AS expected_verdict, CASE WHEN p THEN 'FAIL' ELSE 'PASS' END AS predicted_verdict
FROM (SELECT k, k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0 AS p FROM o)""",
    "score_localization": BASE + """
SELECT k AS shipment, CASE WHEN k % 17 = 0 THEN 'commercial_invoice' WHEN k % 23 = 0 THEN 'packing_list' ELSE 'bill_of_lading' END AS expected_doc_type,
       CASE WHEN k % 17 = 0 THEN 'order_no' WHEN k % 23 = 0 THEN 'cartons' ELSE 'net_kg' END AS expected_field, true AS correct
FROM o WHERE k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0""",
    "score_card": BASE + """,
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0) AS p FROM o)
SELECT n || '/' || n AS grouping_accuracy, 100.0::DOUBLE AS grouping_accuracy_pct, p || '/' || p AS recall, 100.0::DOUBLE AS recall_pct, 1.0::DOUBLE AS precision, CAST(0 AS BIGINT) AS false_positives,
       1.0::DOUBLE AS f1, p || '/' || p AS localization_accuracy, 100.0::DOUBLE AS localization_accuracy_pct, true AS overall_pass FROM c""",
    "feedback_overall": EVENTS + """
SELECT count(*) AS total_reviews, count(*) FILTER (WHERE verdict = 'confirmed') AS confirmed, count(*) FILTER (WHERE verdict = 'rejected') AS rejected,
       count(*) FILTER (WHERE verdict = 'corrected') AS corrected, CAST(printf('%.3f', count(*) FILTER (WHERE verdict = 'confirmed') / count(*)) AS DOUBLE) AS accuracy FROM w""",
    "feedback_by_field": EVENTS + f"SELECT field, {_RATE} FROM w GROUP BY 1",
    "feedback_by_doc_type": EVENTS + f"SELECT doc_type, {_RATE} FROM w WHERE doc_type <> '' GROUP BY 1",
    "feedback_trend": EVENTS + "SELECT day AS date, CAST(printf('%.3f', count(*) FILTER (WHERE verdict = 'confirmed') / count(*)) AS DOUBLE) AS accuracy, count(*) AS count FROM w GROUP BY 1",
    "feedback_boosts": EVENTS + """,
b AS (SELECT string_split(field, '.')[-1] AS field FROM r GROUP BY 1, r.field HAVING count(*) FILTER (WHERE verdict <> 'confirmed') / count(*) > 0.3)
SELECT DISTINCT unnest([field, replace(field, '_', ' ')]) AS label, field FROM b""",
    "feedback_training": EVENTS + """,
n AS (SELECT string_split(field, '.')[-1] AS f, CASE WHEN doc_type <> '' THEN doc_type ELSE 'shipping document' END AS d FROM r WHERE verdict <> 'confirmed')
SELECT 'INPUT: Map label ''' || f || ''' for ' || d || chr(10) || 'OUTPUT: {"' || f || '": "' || f || '"}' || chr(10) AS value, count(*) AS n FROM n GROUP BY 1""",
    "text_hashes": r"SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) || chr(0)) AS hash FROM documents",
    "text_identifiers": "SELECT c_custkey, upper(replace(c_name, ' ', '')) || 'A1' AS key FROM customer",
    "text_numbers": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS n0, l_extendedprice AS n1, l_extendedprice AS n2, l_extendedprice AS n3 FROM lineitem",
    "label_fields": """
SELECT unnest(['order_no', 'bl_no', 'reference', 'container_no', 'seal_no', 'shipper', 'consignee', 'vessel', 'voyage', 'pol', 'pod', 'ship_date', 'description', 'lot', 'cartons', 'pack', 'net_kg', 'gross_kg', 'unit_price', 'units', 'amount', 'value', 'currency', 'invoice_no', 'buyer', 'incoterm', 'notify_party', 'origin_country', 'tare_kg']) AS field,
       unnest([28, 18, 16, 11, 14, 13, 11, 9, 6, 9, 9, 16, 13, 16, 26, 1, 21, 22, 12, 14, 10, 10, 6, 10, 7, 6, 5, 6, 9]) AS n""",
    "doc_types": """
SELECT doc_id, ['bill_of_lading', 'packing_list', 'commercial_invoice', 'unknown'][doc_id % 4 + 1] AS type, CASE WHEN doc_id % 4 = 3 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM documents""",
}

ORACLE_SQL["match_arriving"] = ORACLE_SQL["match_groups"]
