"""The stages as one object: each step is a lazy table that can be looked at by itself."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallymark import schema
from tallymark.operators import extract as ex
from tallymark.operators import feedback, match, verify
from tallymark.plans import report, score
from tallymark.sources import named, scan
from tallymark.tables import settle


#: Stages that can be written and read, with their schemas.
STAGES = {
    "raw": schema.RAW, "documents": schema.CANONICAL, "groups": schema.MEMBERS, "findings": f"{schema.FINDINGS}, n_key bigint, first_ord bigint, ord_b bigint, sev_rank int",
    "verdicts": "group_id string, verdict string, suspect_doc_ids array<string>, n_docs bigint, n_findings bigint",
}


def read_stage(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A stage as it was written: Parquet, JSON lines, or ``array`` for files that hold one JSON array."""
    if name not in STAGES or form not in ("parquet", "json", "array"):
        raise ValueError(f"no such stage or form: {name!r}, {form!r}")
    reader = spark.read.schema(STAGES[name]).option("multiLine", form == "array")
    return reader.parquet(path) if form == "parquet" else reader.json(path)


def check_options(tolerance: float | None = None, messages: int = 1, inbox: bool = False, simulate: bool = False) -> None:
    """ValueError for what a run cannot mean."""
    if tolerance is not None and not (math.isfinite(tolerance) and tolerance >= 0):
        raise ValueError("a tolerance is a finite number, not below 0")
    if messages < 1:
        raise ValueError("at least one message is planned")
    if inbox and simulate:
        raise ValueError("an inbox and simulated messages exclude each other")


class Engine:
    """Raw documents to results.

    Overrides from reviews add labels to the dictionary and set the tolerance, for files and
    streams alike. A tolerance is absolute.
    """

    def __init__(self, raw: DataFrame, tolerance: float | None = None, overrides: str | None = None, fuzzy: bool = True):
        check_options(tolerance)
        self.spark: SparkSession = raw.sparkSession
        self.raw, self.fuzzy = raw, fuzzy
        self.labels, learned = feedback.load_overrides(self.spark, overrides) if overrides else ({}, 0.0)
        self.tolerance = learned if tolerance is None else tolerance

    @classmethod
    def corpus(cls, spark: SparkSession, folder: str, **options) -> Engine:
        raw, errors = scan.scan(spark, folder)
        out = cls(raw, **options)
        out.errors = errors
        return out

    @cached_property
    def documents(self) -> DataFrame:
        return settle(ex.extract(self.raw, extra_labels=self.labels), "canonical")

    @cached_property
    def groups(self) -> DataFrame:
        return settle(match.match(self.documents, fuzzy=self.fuzzy), "groups")

    @cached_property
    def members(self) -> DataFrame:
        return settle(self.documents.join(self.groups.drop("doc_id"), "doc_ord"), "members")

    @cached_property
    def findings(self) -> DataFrame:
        return settle(verify.findings(self.members, self.tolerance), "findings")

    @cached_property
    def verdicts(self) -> DataFrame:
        return settle(verify.verdicts(self.findings, self.members), "verdicts")

    @cached_property
    def results(self) -> DataFrame:
        return settle(report.results(self.members, self.findings), "results")

    def group(self, group_id: str) -> DataFrame:
        return self.results.where(self.results.group_id == group_id)

    def write(self, folder: str, form: str = "parquet", files: bool = False) -> None:
        """All stages, as Parquet, JSON lines or ``array`` (a JSON array a part), and reports under ``folder``.

        ``files`` also writes each report and each draft as a file named after its group. Arrays replace parts of the same number only.
        """
        for name in STAGES:
            if form == "array":
                named.write_arrays(getattr(self, name), f"{folder}/{name}")
            else:
                getattr(self, name).write.mode("overwrite").format(form).save(f"{folder}/{name}")
        report.write(self.results, folder)
        if files:
            report.write_files(report.markdown(self.results), f"{folder}/report_files", ".md")
            report.write_files(report.corrections(self.results), f"{folder}/draft_files", ".txt")

    def score(self, key: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
        numbers = score.shipments(self.members)
        table = score.confusion(key, self.verdicts, numbers)
        return score.scorecard(table, score.localization(key, self.findings, self.members, self.verdicts, numbers), targets)
