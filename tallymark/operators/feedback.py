"""Reviews of findings: log, metrics and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.functions import text

VERDICTS = ("confirmed", "rejected", "corrected")


def wrong() -> Column:
    return F.col("verdict").isin("rejected", "corrected")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log; blank and malformed lines are left out."""
    return spark.read.schema(schema.FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Add reviews to the log; a verdict that is none of the three raises an error."""
    bad = rows.where(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"a verdict is one of {VERDICTS}, not {bad[0]['verdict']!r}")
    rows.select(*[c.split()[0] for c in schema.FEEDBACK.split(", ")]).write.mode("append").json(path)


def recent(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Reviews of the last days; those whose time cannot be read are kept."""
    return rows.where(F.coalesce(F.try_to_timestamp(F.col("timestamp")) >= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(True)))


def overall(rows: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    out = rows.agg(F.count("*").alias("total_reviews"), *map(n, VERDICTS))
    return out.withColumn("accuracy", F.when(F.col("total_reviews") > 0, text.rounded(F.col("confirmed") / F.col("total_reviews"), 3)).otherwise(0.0))


def error_rate(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, error_rate); blank document types are left out."""
    rows = rows.where(F.col(by) != "") if by == "doc_type" else rows
    return rows.groupBy(by).agg(F.count("*").alias("n"), text.rounded(F.count_if(wrong()) / F.count("*"), 3).alias("error_rate"))


def trend(rows: DataFrame) -> DataFrame:
    """(date, accuracy, count) by the day that the time's text starts with."""
    rows = rows.withColumn("date", F.substring("timestamp", 1, 10))
    return rows.groupBy("date").agg(text.rounded(F.count_if(F.col("verdict") == "confirmed") / F.count("*"), 3).alias("accuracy"), F.count("*").alias("count")).orderBy("date")


def boosts(rows: DataFrame, above: float = 0.3) -> DataFrame:
    """(label, field): the names of fields that are often wrong, as labels to add to the dictionary."""
    rates = rows.groupBy("field").agg((F.count_if(wrong()) / F.count("*")).alias("rate")).where(F.col("rate") > above)
    name = F.substring_index("field", ".", -1)
    return rates.select(F.explode(F.array_distinct(F.array(F.replace(name, F.lit("_"), F.lit(" ")), name))).alias("label"), name.alias("field")).distinct()


def tolerances(rows: DataFrame, value: float = 0.02) -> DataFrame:
    """(field, tolerance): an absolute tolerance for weights that reviewers corrected."""
    return rows.where((F.col("verdict") == "corrected") & F.lower("field").contains("kg")).select("field").distinct().withColumn("tolerance", F.lit(value))


def overrides(rows: DataFrame) -> DataFrame:
    """One row: what tuning follows. The least confidence falls as accuracy rises."""
    from tallymark.tables import settle

    rows = settle(rows, "feedback")
    fields = boosts(rows).agg(F.sort_array(F.collect_list(F.struct("label", "field"))).alias("synonyms"))
    near = tolerances(rows).agg(F.sort_array(F.collect_list(F.struct("field", "tolerance"))).alias("numeric_tolerances"))
    # three tables of one row
    all_ = overall(rows).crossJoin(F.broadcast(fields)).crossJoin(F.broadcast(near))
    return all_.select(
        "synonyms", "numeric_tolerances", F.greatest(F.lit(0.0), 0.5 - F.col("accuracy") * 0.3).alias("min_extraction_confidence"),
        F.when(F.col("accuracy") < 0.8, 2).otherwise(3).alias("llm_trigger_threshold"), F.col("total_reviews").alias("feedback_count"),
    )


def save_overrides(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def load_overrides(spark: SparkSession, path: str) -> tuple[dict[str, str], float]:
    """(labels to add, tolerance); what cannot be read means none and 0."""
    shape = "synonyms array<struct<label:string,field:string>>, numeric_tolerances array<struct<field:string,tolerance:double>>"
    try:
        row = spark.read.schema(shape).json(path).first()
    except Exception:  # noqa: BLE001
        return {}, 0.0
    if row is None:
        return {}, 0.0
    return {x["label"]: x["field"] for x in row["synonyms"] or []}, max((x["tolerance"] for x in row["numeric_tolerances"] or []), default=0.0)


# What training examples ask and how they answer.
SYSTEM = "Given a raw field label and a document snippet, map the label to one of these canonical fields: {}. Respond with ONLY a JSON object."


def training_examples(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(example): chat messages as JSON for reviews that were rejected or corrected."""
    name = F.substring_index("field", ".", -1)
    ask = F.concat(F.lit("Map this shipping document label to a canonical field: '"), name, F.lit("'"), F.when(F.col("doc_type") != "", F.concat(F.lit("\nDocument type: "), "doc_type")).otherwise(""), F.when(F.col("notes") != "", F.concat(F.lit("\nContext: "), "notes")).otherwise(""))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    answer = F.concat(F.lit('{"'), name, F.lit('": "'), name, F.lit('"}'))
    about = F.struct("shipment_id", "field", "verdict", "timestamp")
    return rows.where(wrong()).select(F.to_json(F.struct(F.array(message("system", F.lit(SYSTEM.format(", ".join(fields)))), message("user", ask), message("assistant", answer)).alias("messages"), about.alias("metadata"))).alias("example"))


def training_text(rows: DataFrame) -> DataFrame:
    """(value): the same as INPUT and OUTPUT lines."""
    name = F.substring_index("field", ".", -1)
    kind = F.when(F.col("doc_type") != "", F.col("doc_type")).otherwise("shipping document")
    return rows.where(wrong()).select(F.concat(F.lit("INPUT: Map label '"), name, F.lit("' for "), kind, F.lit('\nOUTPUT: {"'), name, F.lit('": "'), name, F.lit('"}\n')).alias("value"))


def dashboard_lines(rows: DataFrame) -> DataFrame:
    """(section, place, name, rate, n): totals, error rates of all fields and document types, worst first, the worst three and the last fourteen days."""
    from tallymark.tables import numbered, settle

    rows = settle(rows, "feedback")
    shape = lambda section, frame: frame.select(F.lit(section).alias("section"), "place", "name", F.col("rate").cast("double").alias("rate"), F.col("n").cast("bigint").alias("n"))
    total = overall(rows)
    each = F.array(*[F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(v).alias("name"), F.col(v).alias("n")) for i, v in enumerate(VERDICTS, 1)])
    counts = total.select(F.inline(each)).withColumn("rate", F.lit(None))
    whole = total.select(F.lit(0).cast("bigint").alias("place"), F.lit("accuracy").alias("name"), F.col("accuracy").alias("rate"), F.col("total_reviews").alias("n"))

    def ranked(by: str) -> DataFrame:
        rates = error_rate(rows, by).select(F.col(by).alias("name"), F.col("error_rate").alias("rate"), "n", (-F.col("error_rate")).alias("order"))
        return numbered(rates, ["order", "name"], "place")

    fields = settle(ranked("field"), "field-rates")
    # three rows against one
    worst = fields.where("place <= 3").crossJoin(F.broadcast(total.select("accuracy", "total_reviews"))).where("total_reviews > 0 and accuracy < 0.7")
    days = trend(rows).orderBy(F.desc("date")).limit(14)  # fourteen days at most
    days = days.select(F.row_number().over(Window.orderBy("date")).cast("bigint").alias("place"), F.col("date").alias("name"), F.col("accuracy").alias("rate"), F.col("count").alias("n"))
    sections = [("totals", whole.unionByName(counts)), ("field", fields), ("doc_type", ranked("doc_type")), ("worst", worst), ("trend", days)]
    out = [shape(name, frame) for name, frame in sections]
    for frame in out[1:]:
        out[0] = out[0].unionByName(frame)
    return out[0]


def _shown(lines: DataFrame, most: int) -> list:
    found = lines.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} lines: write dashboard_lines(rows) instead")
    order = ("totals", "field", "doc_type", "worst", "trend")
    return sorted(found, key=lambda r: (order.index(r["section"]), r["place"]))


def dashboard(rows: DataFrame, most: int = 10_000) -> str:
    """Metrics as text; more lines than ``most`` are an error."""
    found = _shown(dashboard_lines(rows), most)
    lines = []
    for r in found:
        if r["section"] == "totals":
            lines.append(f"reviews {r['n']}  accuracy {r['rate']:.1%}" if r["place"] == 0 else f"{r['name']} {r['n']}")
        elif r["section"] == "worst":
            lines.append(f"needs attention: {r['name']}")
        else:
            lines.append(f"{r['name']:<30} {'#' * round(r['rate'] * 20):<20} {r['rate']:.1%}  {r['n']}")
    return "\n".join(lines)


def dashboard_html(rows: DataFrame, most: int = 10_000) -> str:
    """The same as a page of its own."""
    import html as h

    found = _shown(dashboard_lines(rows), most)
    cells = "".join(f"<tr class='{r['section']}'><td>{r['section']}<td>{h.escape(r['name'] or '')}<td>{'' if r['rate'] is None else format(r['rate'], '.1%')}<td>{r['n']}</tr>" for r in found)
    return f"<!doctype html><meta charset=utf-8><title>Reviews</title><h1>Reviews</h1><table><tr><th>Section<th>Name<th>Rate<th>Reviews</tr>{cells}</table>"


def last(rows: DataFrame, n: int = 50) -> DataFrame:
    return rows.orderBy(F.desc("timestamp")).limit(n)
