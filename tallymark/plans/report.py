"""Results, reports and correction drafts as columns; writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.functions import text
from tallymark.operators import verify
from tallymark.sources import named
from tallymark.tables import of_keys, settle

TOTALS = ("cartons", "net_kg", "gross_kg", "value", "currency")
SHOWN_IDS = ("order_no", "bl_no", "container_no")


def consensus(members: DataFrame, suspects: DataFrame) -> DataFrame:
    """(group_id, identifiers and totals): votes of the documents that are no suspects, or of all if all are.

    Identifiers vote as written, totals as shown; of ties the first document's wins.
    """
    marked = members.join(suspects.withColumn("suspect", F.lit(True)), ["group_id", "doc_id"], "left")
    only = marked.groupBy("group_id").agg(F.bool_and(F.coalesce("suspect", F.lit(False))).alias("all_suspect"))
    voters = marked.join(only, "group_id").where("suspect is null or all_suspect")
    shown = lambda f: text.shown_double(F.col(f"totals.{f}")) if f in ("net_kg", "gross_kg", "value") else F.col(f"totals.{f}").cast("string")
    pairs = [F.struct(F.lit(f).alias("f"), text.blank_to_null(F.col(f"identifiers.{f}")).alias("v")) for f in SHOWN_IDS]
    pairs += [F.struct(F.lit(f).alias("f"), shown(f).alias("v")) for f in TOTALS]
    votes = voters.select("group_id", "doc_ord", F.inline(F.array(*pairs))).where("v is not null").groupBy("group_id", "f", "v").agg(F.count("*").alias("n"), F.min("doc_ord").alias("o"))
    best = votes.groupBy("group_id", "f").agg(F.max_by("v", F.struct("n", -F.col("o"))).alias("v"))
    return best.groupBy("group_id").agg(*[F.max(F.when(F.col("f") == f, F.col("v"))).alias(f) for f in (*SHOWN_IDS, *TOTALS)])


def results(members: DataFrame, found: DataFrame) -> DataFrame:
    """One row a group: verdict, identifiers, totals, documents, suspects and findings in order."""
    judged = verify.verdicts(found, members)
    agreed = consensus(members, verify.suspects(found, members))
    document = F.struct("doc_id", "doc_type", "source_path", "identifiers.order_no", "parties.shipper")
    docs = members.groupBy("group_id").agg(F.array_sort(F.collect_list(document)).alias("documents"))
    finding = F.struct("place", "field", "doc_a", "value_a", "doc_b", "value_b", "severity", "message")
    listed = verify.ordered(found).groupBy("group_id").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    out = judged.join(docs, "group_id").join(agreed, "group_id", "left").join(listed, "group_id", "left")
    empty = F.array().cast("array<struct<place:int,field:string,doc_a:string,value_a:string,doc_b:string,value_b:string,severity:string,message:string>>")
    return out.select(
        "group_id", "verdict", F.struct(*SHOWN_IDS).alias("identifiers"), F.struct(*TOTALS).alias("totals"), "documents", "suspect_doc_ids",
        F.coalesce("findings", empty).alias("findings"),
    )


def failed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``results`` of failed groups: they are told by their findings, and only their documents are met again."""
    groups = settle(found.where(F.col("severity").isin(*verify.FAILING)).select("group_id").distinct(), "failed-groups")
    columns = ("group_id", "doc_id", "doc_ord", "doc_type", "source_path", "identifiers", "parties", "totals")
    return results(settle(of_keys(members.select(*columns), groups, "group_id", groups.count()), "failed-members"), found)


def summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("shipments"), F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count_if(F.col("verdict") == "FAIL").alias("failed"))


def _of(documents: Column, doc_id: Column) -> Column:
    return F.get(F.filter(documents, lambda d: d["doc_id"] == doc_id), F.lit(0))


def _or(c: Column, other: str) -> Column:
    return F.coalesce(text.blank_to_null(c), F.lit(other))


def _others() -> tuple[Column, Column]:
    n = F.size(F.filter("documents", lambda d: ~F.array_contains("suspect_doc_ids", d["doc_id"])))
    return n, F.when(n == 1, "document").otherwise("documents")


def _last_part(field: Column) -> Column:
    return F.replace(F.substring_index(field, ".", -1), F.lit("_"), F.lit(" "))


# The wording of drafts and reports in the two functions below, titles and tables included.
def corrections(rows: DataFrame) -> DataFrame:
    """(group_id, text): a draft for each failed group, naming every finding of high or medium severity."""
    acting = F.filter("findings", lambda f: f["severity"].isin(*verify.FAILING))
    rows = rows.withColumn("acting", acting).where((F.col("verdict") == "FAIL") & (F.size("acting") > 0))
    n, word = _others()
    first = _of(F.col("documents"), F.get("acting", F.lit(0))["doc_a"])
    line = lambda f: F.concat(F.lit("  - "), F.coalesce(text.shown_type(_of(F.col("documents"), f["doc_b"])["doc_type"]), F.lit("document")), F.lit(" ("), _last_part(f["field"]), F.lit('): shows "'), F.coalesce(f["value_b"], F.lit("None")), F.lit('" but should be "'), F.coalesce(f["value_a"], F.lit("None")), F.lit('" per the other '), n.cast("string"), F.lit(" "), word, F.lit(" in this shipment."))
    ids = rows.withColumns({"o": _or(first["order_no"], "N/A"), "s": _or(first["shipper"], "Shipper"), "b": _or(F.col("identifiers.bl_no"), "N/A"), "c": _or(F.col("identifiers.container_no"), "N/A")})
    body = F.concat(
        F.lit("Subject: Correction needed — Order "), "o", F.lit(" / B/L "), "b", F.lit("\n\nDear "), "s",
        F.lit(",\n\nWhile cross-checking the documents for shipment "), "o", F.lit(" (B/L "), "b", F.lit(", container "), "c",
        F.lit(") we found discrepancy(ies) that need correction:\n\n"), F.array_join(F.transform("acting", line), "\n"),
        F.lit("\n\nPlease reissue the corrected document(s) at your earliest convenience so we can clear the shipment without delay.\n\nBest regards,\nLogistics Team"),
    )
    return ids.select("group_id", body.alias("text"))


def markdown(rows: DataFrame) -> DataFrame:
    """(group_id, text): a report for each group."""
    of = lambda kinds: F.filter("findings", lambda f: f["severity"].isin(*kinds))
    rows = rows.withColumns({"acting": of(verify.FAILING), "minor": of(("low",))})
    n, word = _others()
    count = F.size("documents")
    plural = F.when(count == 1, "document").otherwise("documents")
    lead = F.coalesce(F.get(F.filter("documents", lambda d: ~F.array_contains("suspect_doc_ids", d["doc_id"])), F.lit(0)), F.get("documents", F.lit(0)))
    name = lambda f: F.coalesce(_of(F.col("documents"), f["doc_b"])["source_path"], f["doc_b"])
    row = lambda f: F.concat(F.lit("| "), f["field"], F.lit(" | `"), name(f), F.lit("` | "), _or(f["value_b"], "N/A"), F.lit(" | "), _or(f["value_a"], "N/A"), F.lit(" | "), f["severity"], F.lit(" |"))
    table = F.concat(F.lit("## Findings\n\n| Field | Suspect Doc | Found Value | Expected Value | Severity |\n|-------|------------|-------------|----------------|----------|\n"), F.array_join(F.transform("acting", row), "\n"), F.lit("\n"))
    small = F.concat(F.lit("| Field | Detail |\n|-------|--------|\n"), F.array_join(F.transform("minor", lambda f: F.concat(F.lit("| "), f["field"], F.lit(" | "), f["message"], F.lit(" |"))), "\n"), F.lit("\n"))
    noted = F.concat(F.lit("## Minor Observations\n\nThe following "), F.size("minor").cast("string"), F.lit(" low-severity differences were also noted (format variations, items only in one document, etc.):\n\n"), small)
    first = F.get("acting", F.lit(0))
    doc = _of(F.col("documents"), first["doc_b"])
    says = F.concat(F.lit("**Summary:** Likely error: the "), F.coalesce(text.shown_type(doc["doc_type"]), F.lit("Unknown Document")), F.lit(" (`"), F.coalesce(doc["source_path"], F.lit("")), F.lit("`) — "), _last_part(first["field"]), F.lit(" disagrees with "), n.cast("string"), F.lit(" other "), word, F.lit(" in this shipment.\n"))
    has = lambda c: F.size(c) > 0
    failed = F.concat_ws("\n", F.when(has("acting"), table), F.when(has("minor"), noted), F.when(has("acting"), says))
    passed = (
        F.when(count == 1, F.lit("Insufficient documents for cross-reference (1 document in group). No comparison performed.\n"))
        .when(has("minor"), F.concat(F.lit("All critical fields agree across "), count.cast("string"), F.lit(" "), plural, F.lit(".\n\nHowever, "), F.size("minor").cast("string"), F.lit(" minor observation(s) were noted:\n\n"), small))
        .otherwise(F.concat(F.lit("All shared fields agree across "), count.cast("string"), F.lit(" "), plural, F.lit(".\n")))
    )
    head = F.concat(
        F.lit("# Shipment Report — "), "group_id", F.lit("\n\n**Verdict:** "), "verdict", F.lit("\n\n**Order No:** "), _or(lead["order_no"], "N/A"), F.lit("  \n**B/L No:** "),
        _or(F.col("identifiers.bl_no"), "N/A"), F.lit("  \n**Container No:** "), _or(F.col("identifiers.container_no"), "N/A"), F.lit("\n\n**Documents:** "), count.cast("string"), F.lit("\n\n## Documents\n\n"),
        F.array_join(F.transform("documents", lambda d: F.concat(F.lit("- **"), d["doc_type"], F.lit("** — `"), d["source_path"], F.lit("`"))), "\n"), F.lit("\n\n"),
    )
    return rows.select("group_id", F.concat(head, F.when(F.col("verdict") == "FAIL", failed).otherwise(passed)).alias("text"))


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _document(head: DataFrame, lines: DataFrame, tail: DataFrame) -> DataFrame:
    """(value) in order: what the parts of a text file say, one after the other, however many lines there are."""
    parts = [frame.select(F.lit(i).alias("part"), *(c for c in ("a", "b") if c in frame.columns), *(F.lit("").alias(c) for c in ("a", "b") if c not in frame.columns), "value") for i, frame in enumerate((head, lines, tail))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("part", "a", "b").select("value")


def page(rows: DataFrame) -> DataFrame:
    """(value): the lines of a page of its own with all groups, failed ones first."""
    spark = rows.sparkSession
    said = F.concat(F.col("shipments").cast("string"), F.lit(" shipments, "), F.col("passed").cast("string"), F.lit(" passed, "), F.col("failed").cast("string"), F.lit(" failed"))
    head = summary(rows).select(F.concat(F.lit("<!doctype html><meta charset=utf-8><title>Shipments</title><h1>Shipments</h1><p>"), said, F.lit("</p><table><tr><th>Group<th>Verdict<th>Order<th>Documents<th>Findings</tr>")).alias("value"))
    found = F.array_join(F.transform("findings", lambda f: _escaped(F.concat_ws(" ", f["severity"], f["message"]))), "<br>")
    line = F.concat(F.lit("<tr class='"), F.lower("verdict"), F.lit("'><td>"), _escaped(F.col("group_id")), F.lit("<td>"), "verdict", F.lit("<td>"), _escaped(F.coalesce("identifiers.order_no", F.lit(""))), F.lit("<td>"), F.size("documents").cast("string"), F.lit("<td>"), found, F.lit("</tr>"))
    lines = rows.select(F.col("verdict").alias("a"), F.col("group_id").alias("b"), line.alias("value"))
    return _document(head, lines, spark.createDataFrame([("</table>",)], "value string"))


def html(rows: DataFrame, most: int = 10_000) -> str:
    """``page`` as one string, for results that fit one; more groups than ``most`` are an error, and ``page`` can be written."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups: write page(rows) instead")
    return "".join(r["value"] for r in page(rows).collect())


def results_document(rows: DataFrame) -> DataFrame:
    """(value): the lines of one JSON document, {"summary": ..., "shipments": [...]}."""
    spark = rows.sparkSession
    count = F.struct("shipments", "passed", "failed", F.lit("tallymark").alias("generated_by"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"))
    head = summary(rows).select(F.concat(F.lit('{"summary": '), F.to_json(count), F.lit(', "shipments": [')).alias("value"))
    last = rows.agg(F.max("group_id").alias("last"))
    comma = F.when(F.col("group_id") == F.col("last"), F.lit("")).otherwise(F.lit(","))
    lines = rows.crossJoin(F.broadcast(last)).select(F.col("group_id").alias("a"), F.concat(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), comma).alias("value"))  # one row
    return _document(head, lines, spark.createDataFrame([("]}",)], "value string"))


def write(rows: DataFrame, folder: str) -> None:
    """results (JSON lines, and one document in parts), page, reports and corrections under ``folder``, by the cluster's own writers."""
    rows.write.mode("overwrite").json(f"{folder}/results")
    results_document(rows).write.mode("overwrite").text(f"{folder}/results_document")
    page(rows).write.mode("overwrite").text(f"{folder}/page")
    summary(rows).write.mode("overwrite").json(f"{folder}/summary")
    for name, frame in (("reports", markdown(rows)), ("corrections", corrections(rows))):
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_files(texts: DataFrame, folder: str, ending: str) -> None:
    """(group_id, text) as a file a group: report.md or draft.txt of its own, none of it if the job fails."""
    named.write(texts.select(F.concat("group_id", F.lit(ending)).alias("name"), "text"), folder, "name", "text")


def write_archives(texts: DataFrame, folder: str, ending: str) -> None:
    """The files of ``write_files`` in archives: where groups are so many that a block of the file system for each is too much."""
    named.write_packed(texts.select(F.concat("group_id", F.lit(ending)).alias("name"), "text"), folder, "name", "text")


def results_json(rows: DataFrame) -> DataFrame:
    """(group_id, json): each shipment as JSON."""
    return rows.select("group_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def check(rows: DataFrame) -> None:
    allowed = {"PASS", "FAIL"}
    wrong = rows.where(~F.col("verdict").isin(*allowed) | F.exists("findings", lambda f: ~f["severity"].isin(*schema.SEVERITIES))).limit(1).count()
    if wrong:
        raise ValueError("a verdict or severity is not one of those allowed")
