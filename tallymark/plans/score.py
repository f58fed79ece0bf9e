"""Results against an answer key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import text

# Other names of document types, and words that tell the field of a discrepancy, in order.
TYPES = {"invoice": "commercial_invoice", "proforma": "proforma_invoice", "final_confirmation": "confirmation"}
FIELD_WORDS = (
    ("order_no", ("order no", "order_no")), ("container_no", ("container",)), ("bl_no", ("bl no", "bl_no")), ("reference", ("reference",)),
    ("net_kg", ("net_kg", "net kg", "net weight")), ("gross_kg", ("gross_kg", "gross kg", "gross weight")), ("cartons", ("carton",)),
    ("unit_price", ("unit_price", "unit price")), ("value", ("value", "amount", "total")),
)


def doc_type(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), c), c)


def expected_field(detail: Column) -> Column:
    """The field that a discrepancy's description is about: the first whose words it has."""
    low, out = F.lower(detail), F.lit(None).cast("string")
    for field, words in reversed(FIELD_WORDS):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(field)).otherwise(out)
    return out


def shipments(members: DataFrame) -> DataFrame:
    """(group_id, shipment): the commonest number in the file names of a group, or -1."""
    rows = members.select("group_id", "doc_ord", F.substring(text.shipment_prefix(F.col("source_path")), 2, 30).try_cast("bigint").alias("s"))
    votes = rows.where("s is not null").groupBy("group_id", "s").agg(F.count("*").alias("n"), F.min("doc_ord").alias("o"))
    best = votes.groupBy("group_id").agg(F.max_by("s", F.struct("n", -F.col("o"))).alias("s"))
    return members.select("group_id").distinct().join(best, "group_id", "left").select("group_id", F.coalesce("s", F.lit(-1)).alias("shipment"))


def confusion(key: DataFrame, verdicts: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row for each shipment of the key; of several groups with its number the last by id counts."""
    said = verdicts.join(numbers, "group_id").groupBy("shipment").agg(F.max_by("verdict", F.struct(F.length("group_id"), "group_id")).alias("verdict"))
    out = key.join(said, "shipment", "left")
    planted, predicted = F.col("has_planted_discrepancy"), F.coalesce("verdict", F.lit("N/A"))
    expected = F.when(planted, "FAIL").otherwise("PASS")
    return out.select("shipment", planted.alias("planted_error"), expected.alias("expected_verdict"), predicted.alias("predicted_verdict"), (expected == predicted).alias("correct"))


def localization(key: DataFrame, found: DataFrame, members: DataFrame, verdicts: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row for each planted shipment that failed: whether a high finding names document type and field."""
    asked = key.where("has_planted_discrepancy").select("shipment", doc_type(F.col("discrepancy_in_doc_type")).alias("expected_doc_type"), expected_field(F.get("discrepancy_detail", F.lit(0))).alias("expected_field"))
    failed = verdicts.where("verdict = 'FAIL'").join(numbers, "group_id").select("group_id", "shipment")
    high = found.where("severity = 'high'").join(members.select("group_id", F.col("doc_id").alias("doc_b"), "doc_type"), ["group_id", "doc_b"])
    order = F.struct("field", F.col("n_key"), "first_ord", "ord_b")
    rows = asked.join(failed, "shipment").join(high, "group_id", "left").withColumn("name", F.substring_index("field", ".", -1))
    hit = (F.col("doc_type") == F.col("expected_doc_type")) & (F.col("expected_field").isNull() | (F.col("name") == F.col("expected_field")))
    out = rows.groupBy("shipment", "expected_doc_type", "expected_field").agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("correct"),
        F.coalesce(F.max(F.when(hit, F.col("doc_type"))), F.max_by("doc_type", order)).alias("found_doc_type"),
        F.coalesce(F.max(F.when(hit, F.col("name"))), F.max_by("name", order)).alias("found_field"),
    )
    return out.select("shipment", "expected_doc_type", "expected_field", "found_doc_type", "found_field", "correct")


def scorecard(table: DataFrame, located: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row of measures. ``targets`` are least values for recall, grouping, localization and most for false_positives."""
    aim = {"recall": 1.0, "grouping": 1.0, "localization": 0.8, "false_positives": 0} | (targets or {})
    n = lambda c: F.count_if(c)
    fail = F.col("predicted_verdict") == "FAIL"
    counts = table.agg(
        F.count("*").alias("n"), n(F.col("predicted_verdict") != "N/A").alias("grouped"), n(F.col("planted_error")).alias("planted"),
        n(F.col("planted_error") & fail).alias("tp"), n(~F.col("planted_error") & fail).alias("fp"),
    ).crossJoin(F.broadcast(located.agg(F.count("*").alias("located"), n(F.col("correct")).alias("right"))))  # fmt: skip  # one row by one row
    rate = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    counts = counts.withColumns({"positives": F.col("tp") + F.col("fp"), "recall": rate("tp", "planted", 1.0), "grouping": rate("grouped", "n", 0.0), "localization": rate("right", "located", 0.0)})
    counts = counts.withColumn("precision", rate("tp", "positives", 1.0))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    reached = (F.col("recall") >= aim["recall"]) & (F.col("grouping") >= aim["grouping"]) & (F.col("localization") >= aim["localization"]) & (F.col("fp") <= aim["false_positives"])
    share = lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    return counts.select(
        share("grouped", "n").alias("grouping_accuracy"), text.rounded(F.col("grouping") * 100, 1).alias("grouping_accuracy_pct"), share("tp", "planted").alias("recall"),
        text.rounded(F.col("recall") * 100, 1).alias("recall_pct"), text.rounded(F.col("precision"), 3).alias("precision"), F.col("fp").alias("false_positives"), text.rounded(f1, 3).alias("f1"),
        share("right", "located").alias("localization_accuracy"), text.rounded(F.col("localization") * 100, 1).alias("localization_accuracy_pct"), reached.alias("overall_pass"),
    )


KEY = "answer_key array<struct<shipment: bigint, order_no: string, bl_no: string, container: string, has_planted_discrepancy: boolean, discrepancy_in_doc_type: string, discrepancy_detail: array<string>>>"


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """An answer key file, {"answer_key": [...]}; of several entries for a shipment the last counts."""
    rows = spark.read.schema(KEY).option("multiLine", True).json(path).select(F.posexplode("answer_key").alias("at", "k"))
    return rows.groupBy("k.shipment").agg(F.max_by("k", "at").alias("k")).select("k.*")


def export(card: DataFrame, table: DataFrame, located: DataFrame, folder: str, targets: dict[str, float] | None = None) -> None:
    """scorecard (one JSON object), confusion and localization (JSON lines, sorted by shipment) under ``folder``."""
    aim = {"recall": 1.0, "grouping": 1.0, "localization": 0.8, "false_positives": 0} | (targets or {})
    shown = card.withColumn("targets", F.create_map(*[F.lit(x) for k, v in aim.items() for x in (k, float(v))]))
    shown.coalesce(1).write.mode("overwrite").json(f"{folder}/scorecard")  # one row
    for name, rows in (("confusion", table), ("localization", located)):
        rows.orderBy("shipment").write.mode("overwrite").json(f"{folder}/{name}")


def pairwise(members: DataFrame, truth: Column) -> DataFrame:
    """True pairwise precision and recall of grouping, from group sizes and not from pairs."""
    rows = members.select("group_id", truth.alias("t"))
    pairs = lambda frame, *by: frame.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    both, got, want = (pairs(rows, *by) for by in (("group_id", "t"), ("group_id",), ("t",)))
    all_ = both.withColumnRenamed("p", "b").crossJoin(F.broadcast(got.withColumnRenamed("p", "g"))).crossJoin(F.broadcast(want.withColumnRenamed("p", "w")))  # one row each
    return all_.select((F.col("b") / F.col("g")).alias("precision"), (F.col("b") / F.col("w")).alias("recall"))
