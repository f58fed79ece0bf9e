"""Named queries that write files and read them back: documents, mail, stages, results, keys and reviews, and their SQL.

The files are made from the driver's tables in the shared folder; the SQL states what must come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import feedback as fb
from tallymark.operators import verify as ve
from tallymark.plans import engine, queries
from tallymark.plans import report as re_
from tallymark.plans import score as sc
from tallymark.sources import personas, render, scan
from tallymark.streaming import inbox
from tallymark.tables import fresh_path, settle

FORMS = ("docx", "xlsx", "pdf")


def _key() -> Column:
    return F.lpad(F.col("s_suppkey").cast("string"), 6, "0")


def _supplied(spark: SparkSession, sf_dir: str, forms=FORMS) -> DataFrame:
    """RAW documents, one for each supplier and form; the PDF file states other cartons for every 7th."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(F.array(*map(F.lit, forms))).alias("form"))
    cartons = F.when((F.col("s_suppkey") % 7 == 0) & (F.col("form") == "pdf"), "8").otherwise("7")
    texts = lambda *cells: F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cells])
    table = F.array(texts("Lot", "Description", "Cartons"), texts("L1", F.concat(F.lit("Pasta "), _key()), "5"), texts("L2", "Rice", cartons))
    text = F.concat(F.when(F.col("form") == "xlsx", "").otherwise("Commercial Invoice\n"), F.lit("Order No: ORD-"), _key(), F.lit("\nB/L No: BL"), _key(), F.when(F.col("form") == "xlsx", "\nShip Date: 2024-01-15").otherwise(""))
    path = F.concat(F.lit("/in/S"), _key(), F.lit("_invoice."), "form")
    return rows.select(F.lit(None).cast("string").alias("doc_id"), path.alias("source_path"), F.col("form").alias("source_format"), text.alias("text"), F.array(table).alias("tables"), F.lit(None).cast("bigint").alias("doc_ord"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    folder = fresh_path(spark, "documents")
    render.write(_supplied(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return folder


def files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, Excel and PDF files to text and tables."""
    raw, _ = scan.scan(spark, _folder(spark, sf_dir), logical="/corpus")
    return raw.select("source_path", "source_format", "text", F.to_json("tables").alias("tables"), "doc_ord", (F.length("doc_id") == 64).alias("has_id"))


def files_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue by shipment, without contents."""
    folder = _folder(spark, sf_dir)
    return scan.listing(spark, folder).join(scan.catalogue(spark, folder).where("size_kb > 0 and modified is not null").select("name", "type"), "name")


def files_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shipment and two documents drawn from a folder, and one document read by its name."""
    folder = _folder(spark, sf_dir)
    listed = settle(scan.listing(spark, folder), "listing")
    one, two = scan.pick_shipment(listed), scan.pick_documents(listed, 2)
    read = scan.document(spark, folder, listed.agg(F.min("name")).first()[0])
    rows = [one.agg(F.lit("shipment").alias("what"), F.count("*").alias("n"), F.countDistinct("shipment").alias("shipments")), two.agg(F.lit("documents").alias("what"), F.count("*").alias("n"), F.lit(1).cast("bigint").alias("shipments"))]
    return rows[0].unionByName(rows[1]).unionByName(read.agg(F.lit("read").alias("what"), F.count("*").alias("n"), F.count("error").alias("shipments")))


def _broken(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files that cannot be read, one for each nation."""
    folder = fresh_path(spark, "broken")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")

    def work(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))
        system.create_dir(base, recursive=True)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, content = ((f"n{k}.docx", b"no archive"), (f"n{k}.pdf", b"no file of this kind"), (f"n{k}.xlsx", b""), (f"n{k}.txt", b"text"))[k % 4]
                with system.open_output_stream(f"{base}/{name}") as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())], ["k"])

    rows.mapInArrow(work, "k bigint").write.format("noop").mode("overwrite").save()
    return folder


def files_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a folder by name and size, those without content too."""
    folder = _broken(spark, sf_dir)
    types = scan.catalogue(spark, folder).where("modified is not null").select("name", "type", "size_kb")
    return scan.listed(spark, folder).join(types, "name").select("name", "length", "type", "size_kb")


def files_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be read: no archive, no PDF, empty; whatever else lies there is passed over."""
    raw, errors = scan.scan(spark, _broken(spark, sf_dir))
    kind = F.when(F.col("error") == "empty file", "empty").when(F.col("error").startswith("BadZipFile"), "archive").otherwise("pdf")
    return errors.select(F.regexp_extract("source_path", r"([^/]*)$", 1).alias("name"), kind.alias("kind")).unionByName(raw.select(F.col("source_path").alias("name"), F.lit("read").alias("kind")))


def inbox_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail with encoded headers, dropped into a folder and read as a stream: attachments to documents."""
    folder, out = fresh_path(spark, "inbox"), fresh_path(spark, "arrived")
    render.write(_supplied(spark, sf_dir, ("docx",)), folder, as_mail=True).write.format("noop").mode("overwrite").save()
    inbox.ingest(spark, folder, out, fresh_path(spark, "seen")).awaitTermination()
    return spark.read.parquet(out).select("source_path", "source_format", "identifiers.order_no", "totals.cartons", F.size("line_items").alias("n_items"))


def engine_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files all the way: scanned, run, every stage written in three forms and read back, one group looked up."""
    raw, _ = scan.scan(spark, _folder(spark, sf_dir), logical="/corpus")
    run, counts = engine.Engine(settle(raw, "raw")), None
    for form in ("parquet", "json", "array"):
        folder = fresh_path(spark, "stages")
        run.write(folder, form)
        for name in engine.STAGES:
            rows = engine.read_stage(spark, f"{folder}/{name}", name, form).agg(F.lit(f"{name} {form}").alias("stage"), F.count("*").alias("n"))
            counts = rows if counts is None else counts.unionByName(rows)
    return counts.unionByName(run.group("G01").agg(F.lit("one group").alias("stage"), F.sum(F.size("documents")).alias("n")))


def results_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one JSON document of all results, written in parts, and its shipments read from it."""
    raw, _ = scan.scan(spark, _folder(spark, sf_dir), logical="/corpus")
    run, folder = engine.Engine(settle(raw, "raw")), fresh_path(spark, "results")
    re_.results_document(run.results).write.text(folder)
    lines = spark.read.text(folder)
    shape = "group_id string, verdict string, identifiers struct<order_no:string>, documents array<struct<doc_id:string>>, findings array<struct<field:string>>, shipments bigint"
    said = F.from_json(F.regexp_replace(F.regexp_replace("value", r'^\{"summary": (.*), "shipments": \[$', "$1"), ",$", ""), shape)
    return lines.where("value <> ']}'").select(said.alias("s")).select("s.group_id", "s.verdict", "s.identifiers.order_no", F.size("s.documents").alias("documents"), F.size("s.findings").alias("findings"), "s.shipments")


def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of all groups, line by line."""
    members = queries._members(spark, sf_dir)
    return re_.page(re_.results(members, settle(ve.findings(members), "findings")))


def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key file with twice stated shipments, read back."""
    path = fresh_path(spark, "key")
    entry = F.struct(F.col("s_suppkey").cast("bigint").alias("shipment"), F.concat(F.lit("ORD-"), _key()).alias("order_no"), F.concat(F.lit("BL"), _key()).alias("bl_no"), F.lit("C").alias("container"), (F.col("s_suppkey") % 7 == 0).alias("has_planted_discrepancy"), F.lit("pdf").alias("discrepancy_in_doc_type"), F.array(F.lit("cartons differ")).alias("discrepancy_detail"))
    old = entry.withField("order_no", F.lit("old"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.explode(F.array(F.struct(F.lit(0).alias("at"), old.alias("e")), F.struct(F.lit(1).alias("at"), entry.alias("e")))).alias("x"))
    # a key file is one JSON object: that is its form, of one line for each of two entries a supplier
    rows.groupBy().agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("answer_key")).write.json(path)
    return sc.read_key(spark, path).select("shipment", "order_no", "bl_no", "container", "has_planted_discrepancy", "discrepancy_in_doc_type", F.get("discrepancy_detail", F.lit(0)).alias("detail"))


def score_card_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorecard that is not perfect: the key misses the carton errors and has errors that no document shows; written and read back."""
    members, found, verdicts, numbers, key = queries._scored(spark, sf_dir)
    missed, unknown = F.col("shipment") % 13 == 0, (F.col("shipment") % 23 == 0) & (F.col("shipment") % 17 != 0) & (F.col("shipment") % 31 != 0) & (F.col("shipment") % 13 != 0)
    key = key.withColumn("has_planted_discrepancy", F.when(missed, True).when(unknown, False).otherwise(F.col("has_planted_discrepancy")))
    table, located, folder = sc.confusion(key, verdicts, numbers), sc.localization(key, found, members, verdicts, numbers), fresh_path(spark, "score")
    sc.export(sc.scorecard(table, located), table, located, folder)
    wrong = spark.read.json(f"{folder}/confusion").agg(F.count_if(~F.col("correct")).alias("wrong"))
    card = spark.read.json(f"{folder}/scorecard").select("grouping_accuracy", "recall", "false_positives", "localization_accuracy", "overall_pass", F.col("targets.localization").alias("aim"))
    return card.crossJoin(F.broadcast(wrong))  # one row by one row


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews appended to a log twice, with lines in it that are no reviews."""
    path = fresh_path(spark, "reviews")
    rows = queries.feedback_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    fb.append(rows, path)
    spark.createDataFrame([("no review",), ("",), ('{"verdict": ',)], "value string").write.mode("append").text(path)
    fb.append(rows.where("verdict = 'rejected'"), path)
    return fb.read(spark, path).groupBy("verdict", "doc_type").agg(F.count("*").alias("n"))


def feedback_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tuning follows from all reviews, saved, loaded, and used to read documents; a file that is not there means defaults."""
    path = fresh_path(spark, "overrides")
    fb.save_overrides(fb.overrides(queries.feedback_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))), path)
    names, tolerance = fb.load_overrides(spark, path)
    none = fb.load_overrides(spark, fresh_path(spark, "missing"))
    run = engine.Engine(_supplied(spark, sf_dir), overrides=path)
    rows = [("label", k, v) for k, v in names.items()] + [("tolerance", str(tolerance), str(run.tolerance)), ("missing", str(len(none[0])), str(none[1])), ("applied", "", str(run.labels == names))]
    return spark.createDataFrame(rows, "what string, name string, value string")


def feedback_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples as chat messages, written and read back."""
    path = fresh_path(spark, "examples")
    fb.training_examples(queries.feedback_rows(spark.read.parquet(f"{sf_dir}/events.parquet")), ["order_no", "net_kg"]).write.text(path)
    at = lambda p: F.get_json_object("value", p)
    return spark.read.text(path).groupBy(at("$.messages[1].content").alias("ask"), at("$.messages[2].content").alias("answer"), at("$.metadata.verdict").alias("verdict"), at("$.messages[0].role").alias("role")).agg(F.count("*").alias("n"))


def feedback_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.dashboard_lines(queries.feedback_rows(spark.read.parquet(f"{sf_dir}/events.parquet")))


def feedback_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.last(queries.feedback_rows(spark.read.parquet(f"{sf_dir}/events.parquet")), 20).select("timestamp")


def messages_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message a supplier, with all its documents; nothing is sent. The sender is drawn, so its texts are only told to fit."""
    docs = _supplied(spark, sf_dir).select(F.substring("source_path", 6, 6).cast("bigint").alias("shipment"), F.concat(F.lit("ORD-"), F.substring("source_path", 6, 6)).alias("order_no"), "source_path")
    out = personas.planned(docs, mode="existing").join(F.broadcast(personas.personas(spark).withColumnsRenamed({"role": "r", "language": "l"})), F.col("sender") == F.col("name"))  # a few rows
    fits = F.col("subject").endswith(F.substring(F.get("attachments", F.lit(0)), 6, 6)) & F.col("body").contains(F.concat(F.lit("_invoice.docx, S"), F.substring(F.get("attachments", F.lit(0)), 6, 6))) & (F.col("r") == F.col("role")) & (F.col("l") == F.col("language"))
    return out.select("shipment", F.array_join("attachments", " ").alias("attachments"), "mode", "status", fits.alias("fits"))


QUERIES = {
    f.__name__: f
    for f in (
        files_scan, files_listing, files_picks, files_catalogue, files_errors, inbox_documents, engine_stages, results_file, report_page, score_files, score_card_errors, feedback_log, feedback_overrides,
        feedback_examples, feedback_dashboard, feedback_last, messages_planned,
    )
}

_DOCS = """
WITH s AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS key, unnest(['docx', 'pdf', 'xlsx']) AS form FROM supplier),
d AS (SELECT *, CASE WHEN k % 7 = 0 AND form = 'pdf' THEN '8' ELSE '7' END AS c, 'S' || key || '_invoice.' || form AS name FROM s)
"""
_REVIEWS = """
WITH r AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, ts, props, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'corrected' ELSE 'confirmed' END AS verdict,
         ['identifiers.order_no', 'totals.net_kg', 'totals.cartons', 'parties.shipper', 'logistics.vessel'][user_id % 5 + 1] AS field,
         ['commercial_invoice', 'packing_list', 'bill_of_lading', ''][event_id % 4 + 1] AS doc_type
  FROM events)
"""

ORACLE_SQL = {
    "files_scan": _DOCS + """
SELECT '/corpus/' || name AS source_path, form AS source_format,
  CASE form WHEN 'xlsx' THEN '[Sheet: Invoice]' || chr(10) || 'Order No: ORD-' || key || chr(10) || 'B/L No: BL' || key || chr(10) || 'Ship Date: 2024-01-15 00:00:00' || chr(10)
    ELSE 'Commercial Invoice' || chr(10) || 'Order No: ORD-' || key || chr(10) || 'B/L No: BL' || key || chr(10) || CASE WHEN form = 'pdf' THEN 'LotDescriptionCartons' || chr(10) || 'L1Pasta ' || key || '5' || chr(10) || 'L2Rice' || c || chr(10) ELSE '' END END
    || 'Lot' || chr(9) || 'Description' || chr(9) || 'Cartons' || chr(10) || 'L1' || chr(9) || 'Pasta ' || key || chr(9) || '5' || chr(10) || 'L2' || chr(9) || 'Rice' || chr(9) || c AS text,
  '[[' || CASE WHEN form = 'xlsx' THEN '["Order No","ORD-' || key || '",""],["B/L No","BL' || key || '",""],["Ship Date","2024-01-15 00:00:00",""],' ELSE '' END
    || '["Lot","Description","Cartons"],["L1","Pasta ' || key || '","5"],["L2","Rice","' || c || '"]]]' AS tables,
  row_number() OVER (ORDER BY name) - 1 AS doc_ord, true AS has_id
FROM d""",
    "files_listing": _DOCS + "SELECT 'S' || key AS shipment, name, form AS type FROM d",
    "files_picks": "SELECT 'shipment' AS what, CAST(3 AS BIGINT) AS n, CAST(1 AS BIGINT) AS shipments UNION ALL SELECT 'documents', 2, 1 UNION ALL SELECT 'read', 1, 0",
    "files_catalogue": "SELECT 'n' || n_nationkey || '.' || t AS name, length, t AS type, 0.0::DOUBLE AS size_kb FROM (SELECT *, ['docx', 'pdf', 'xlsx'][n_nationkey % 4 + 1] AS t, CAST([10, 20, 0][n_nationkey % 4 + 1] AS BIGINT) AS length FROM nation WHERE n_nationkey % 4 < 3)",
    "files_errors": "SELECT 'n' || n_nationkey || ['.docx', '.pdf', '.xlsx'][n_nationkey % 4 + 1] AS name, ['archive', 'pdf', 'empty'][n_nationkey % 4 + 1] AS kind FROM nation WHERE n_nationkey % 4 < 3",
    "inbox_documents": _DOCS + "SELECT 'email://Übersicht ' || name AS source_path, form AS source_format, 'ORD-' || key AS order_no, CAST(12 AS BIGINT) AS cartons, 2 AS n_items FROM d WHERE form = 'docx'",
    "engine_stages": """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 7 = 0) AS bad FROM supplier),
s AS (SELECT unnest(['raw', 'documents', 'groups', 'verdicts']) AS name, unnest([3, 3, 3, 1]) AS times),
f AS (SELECT unnest(['parquet', 'json', 'array']) AS form)
SELECT name || ' ' || form AS stage, CAST(n * times AS BIGINT) AS n FROM s, f, n
UNION ALL SELECT 'findings ' || form, CAST(2 * bad AS BIGINT) FROM f, n
UNION ALL SELECT 'one group', 3""",
    "results_file": """
SELECT printf('G%02d', row_number() OVER (ORDER BY s_suppkey)) AS group_id, CASE WHEN s_suppkey % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, 'ORD-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS order_no,
       3 AS documents, CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 0 END AS findings, CAST(NULL AS BIGINT) AS shipments FROM supplier
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*) FROM supplier""",
    "report_page": queries.PLANTED + """,
m AS (SELECT k, string_agg('high ' || field || ' mismatch: 2 of 3 docs show ' || value_a || ', doc shows ' || value_b, '<br>' ORDER BY field) AS said FROM f GROUP BY k)
SELECT '<tr class=''' || CASE WHEN said IS NULL THEN 'pass' ELSE 'fail' END || '''><td>O' || k || '<td>' || CASE WHEN said IS NULL THEN 'PASS' ELSE 'FAIL' END || '<td>' || order_no || '<td>3<td>' || coalesce(said, '') || '</tr>' AS value FROM o LEFT JOIN m USING (k)
UNION ALL SELECT '</table>'
UNION ALL SELECT '<!doctype html><meta charset=utf-8><title>Shipments</title><h1>Shipments</h1><p>' || count(*) || ' shipments, ' || count(*) FILTER (WHERE said IS NULL) || ' passed, ' || count(said) || ' failed</p><table><tr><th>Group<th>Verdict<th>Order<th>Documents<th>Findings</tr>' FROM o LEFT JOIN m USING (k)""",
    "score_files": """
SELECT s_suppkey AS shipment, 'ORD-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS order_no, 'BL' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS bl_no, 'C' AS container, s_suppkey % 7 = 0 AS has_planted_discrepancy, 'pdf' AS discrepancy_in_doc_type, 'cartons differ' AS detail FROM supplier""",
    "score_card_errors": queries.BASE + """,
p AS (SELECT k, k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0 AS real, k % 17 = 0 OR k % 23 = 0 OR k % 31 = 0 AS shown FROM o),
q AS (SELECT *, CASE WHEN k % 13 = 0 THEN true WHEN k % 23 = 0 AND k % 17 <> 0 AND k % 31 <> 0 THEN false ELSE real END AS keyed FROM p),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE keyed) AS planted, count(*) FILTER (WHERE keyed AND shown) AS tp, count(*) FILTER (WHERE NOT keyed AND shown) AS fp, count(*) FILTER (WHERE keyed <> shown) AS wrong FROM q)
SELECT n || '/' || n AS grouping_accuracy, tp || '/' || planted AS recall, fp AS false_positives, tp || '/' || tp AS localization_accuracy, tp = planted AND fp = 0 AS overall_pass, 0.8::DOUBLE AS aim, wrong FROM c""",
    "feedback_log": _REVIEWS + "SELECT verdict, doc_type, CAST(count(*) * CASE WHEN verdict = 'rejected' THEN 2 ELSE 1 END AS BIGINT) AS n FROM r GROUP BY 1, 2",
    "feedback_overrides": _REVIEWS + """,
b AS (SELECT string_split(field, '.')[-1] AS field FROM r GROUP BY 1, r.field HAVING count(*) FILTER (WHERE verdict <> 'confirmed') / count(*) > 0.3),
t AS (SELECT CASE WHEN count(*) > 0 THEN '0.02' ELSE '0.0' END AS t FROM r WHERE verdict = 'corrected' AND lower(field) LIKE '%kg%')
SELECT DISTINCT 'label' AS what, unnest([field, replace(field, '_', ' ')]) AS name, field AS value FROM b
UNION ALL SELECT 'tolerance', t, t FROM t UNION ALL SELECT 'missing', '0', '0.0' UNION ALL SELECT 'applied', '', 'True'""",
    "feedback_examples": _REVIEWS + """,
n AS (SELECT *, string_split(field, '.')[-1] AS f FROM r WHERE verdict <> 'confirmed')
SELECT 'Map this shipping document label to a canonical field: ''' || f || '''' || CASE WHEN doc_type <> '' THEN chr(10) || 'Document type: ' || doc_type ELSE '' END || CASE WHEN props <> '' THEN chr(10) || 'Context: ' || props ELSE '' END AS ask,
       '{"' || f || '": "' || f || '"}' AS answer, verdict, 'system' AS role, count(*) AS n FROM n GROUP BY 1, 2, 3, 4""",
    "feedback_dashboard": _REVIEWS + """,
w AS (SELECT count(*) AS n, round(count(*) FILTER (WHERE verdict = 'confirmed') / count(*), 3) AS accuracy FROM r),
fr AS (SELECT field AS name, round(count(*) FILTER (WHERE verdict <> 'confirmed') / count(*), 3) AS rate, count(*) AS n FROM r GROUP BY 1),
fp AS (SELECT row_number() OVER (ORDER BY rate DESC, name) AS place, * FROM fr),
dr AS (SELECT doc_type AS name, round(count(*) FILTER (WHERE verdict <> 'confirmed') / count(*), 3) AS rate, count(*) AS n FROM r WHERE doc_type <> '' GROUP BY 1),
tr AS (SELECT day AS name, round(count(*) FILTER (WHERE verdict = 'confirmed') / count(*), 3) AS rate, count(*) AS n FROM r GROUP BY 1 ORDER BY day DESC LIMIT 14)
SELECT 'totals' AS section, CAST(0 AS BIGINT) AS place, 'accuracy' AS name, accuracy AS rate, n FROM w
UNION ALL SELECT 'totals', list_position(['confirmed', 'rejected', 'corrected'], v), v, NULL, count(*) FILTER (WHERE verdict = v) FROM r, (SELECT unnest(['confirmed', 'rejected', 'corrected']) AS v) GROUP BY v
UNION ALL SELECT 'field', place, name, rate, n FROM fp
UNION ALL SELECT 'worst', place, name, rate, fp.n FROM fp, w WHERE place <= 3 AND accuracy < 0.7
UNION ALL SELECT 'doc_type', row_number() OVER (ORDER BY rate DESC, name), name, rate, n FROM dr
UNION ALL SELECT 'trend', row_number() OVER (ORDER BY name), name, rate, n FROM tr""",
    "feedback_last": "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp FROM events ORDER BY 1 DESC LIMIT 20",
    "messages_planned": """
SELECT s_suppkey AS shipment, '/in/S' || key || '_invoice.docx /in/S' || key || '_invoice.pdf /in/S' || key || '_invoice.xlsx' AS attachments, 'existing' AS mode, 'dry_run' AS status, true AS fits
FROM (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS key FROM supplier)""",
}
