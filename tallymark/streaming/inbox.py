"""Documents that arrive: messages dropped into a folder, attachments out of them, and reviews as a stream.

What has been handled is what the query's checkpoint says, and that moves on only after the sink has
written; a message is never lost between being seen and being stored.
"""

from __future__ import annotations

import email
import email.header
import email.policy
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark import schema
from tallymark.functions import text
from tallymark.sources import mail, scan

ATTACHMENTS = "message string, name string, content binary, error string"


def decoded(value: str | None) -> str:
    """A header with its encoded words decoded; what cannot be is left as it is."""
    try:
        return str(email.header.make_header(email.header.decode_header(value or "")))
    except (LookupError, UnicodeError, email.errors.HeaderParseError):
        return value or ""


def attachments(message: bytes) -> list[tuple[str, bytes]]:
    """(file name, content) of the attached documents; names lose any folder."""
    out = []
    for part in email.message_from_bytes(message, policy=email.policy.compat32).walk():
        name = os.path.basename(decoded(part.get_filename()).replace("\\", "/")) if part.get_filename() else ""
        if name.rpartition(".")[2].lower() in schema.FORMATS:
            out.append((name, part.get_payload(decode=True) or b""))
    return out


def _unpacked(batches):
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                rows += [(path, name, data, None) for name, data in attachments(content.as_py() or b"")]
            except Exception as e:  # noqa: BLE001  # one bad message does not stop the others
                rows.append((path, None, None, f"{type(e).__name__}: {e}"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], ["message", "name", "content", "error"])


#: Bytes of messages that a batch reads, about. A batch costs seconds of planning whatever it holds, so small messages come in large numbers.
AT_ONCE = 64 << 20


def messages(spark: SparkSession, folder: str, most: int | None = None, size: int = AT_ONCE) -> DataFrame:
    """A stream of message files (.eml), ``size`` bytes at a time, or ``most`` files."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    bound = {"maxBytesPerTrigger": size} if most is None else {"maxFilesPerTrigger": most}
    return reader.option("pathGlobFilter", "*.eml").options(**bound).load(folder)


def mailbox(spark: SparkSession, **options: str) -> DataFrame:
    """A stream of the messages of a mailbox (``sources.mail``) in the form of ``messages``."""
    spark.dataSource.register(mail.Mailbox)
    return spark.readStream.format(mail.FORMAT).options(**options).load().select(F.concat(F.lit("mail://"), F.col("uid").cast("string")).alias("path"), "content")


def unpacked(arrived: DataFrame) -> DataFrame:
    """Messages to (source_path, source_format, text, tables, error): attachments, and what cannot be read with its error."""
    found = arrived.select("path", "content").mapInArrow(_unpacked, ATTACHMENTS)
    parsed = found.where("error is null").select(F.concat(F.lit("email://"), "name").alias("path"), "content").mapInArrow(scan._parsed, scan.PARSED)
    bad = found.where("error is not null").select(F.col("message").alias("source_path"), F.lit("eml").alias("source_format"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<array<array<string>>>").alias("tables"), "error")
    return parsed.unionByName(bad)


def raw_documents(arrived: DataFrame) -> DataFrame:
    """Messages to RAW without numbers; paths are email://name, and ids follow from those."""
    return unpacked(arrived).where("error is null").select(text.content_hash(F.col("text"), F.col("source_path")).alias("doc_id"), "source_path", "source_format", "text", "tables")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, handle=None, errors: str | None = None, groups: str | None = None, arrived: DataFrame | None = None) -> StreamingQuery:
    """Everything that has arrived, once: extracted documents are appended to ``out``, what cannot be read to ``errors``.

    ``arrived`` is another stream of messages than ``folder``'s, such as a ``mailbox``. ``groups`` names a folder in which the groups of all that arrived are kept (``streaming.groups``).
    ``handle`` is called with each batch that was stored, to match and verify anew. Documents are numbered by their paths
    inside a batch, so that a batch that is repeated gives the same rows.
    """
    from tallymark.operators.extract import extract
    from tallymark.streaming.groups import Groups
    from tallymark.tables import numbered, settle, temporary

    def store(batch: DataFrame, number: int) -> None:
        with temporary():
            parsed = settle(unpacked(batch), "inbox")
            rows = parsed.where("error is null").select(text.content_hash(F.col("text"), F.col("source_path")).alias("doc_id"), "source_path", "source_format", "text", "tables")
            placed = numbered(rows, ["source_path", "doc_id"], "place").withColumn("doc_ord", F.lit(number).cast("bigint") * (1 << 40) + F.col("place") - 1).drop("place")
            extract(placed).write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same batch again replaces itself
            parsed.where("error is not null").select("source_path", "error").write.mode("overwrite").parquet(f"{errors or out.rstrip('/') + '-errors'}/batch={number}")
        if groups is not None:
            Groups(spark, groups).absorb(spark.read.parquet(f"{out}/batch={number}"), number)
        if handle is not None:
            handle(spark.read.parquet(out), number)

    return (messages(spark, folder) if arrived is None else arrived).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def review_metrics(reviews: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily accuracy and error counts of a stream (or table) of reviews with a ``ts``."""
    timed = reviews.withWatermark("ts", delay) if reviews.isStreaming else reviews
    return timed.groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict").isin("rejected", "corrected")).alias("wrong")
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "n", "confirmed", "wrong")
