"""Simulated senders of documents: who writes, in which language, and what. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Invented values: the senders, with the share of their messages that carry an error.
PERSONAS = (
    ("origin_desk", "shipper", "en", 0.1), ("carrier_agent", "logistics", "en", 0.05), ("depot", "warehouse", "en", 0.05), ("import_desk", "consignee", "en", 0.1),
    ("forwarder", "logistics", "it", 0.15), ("mill", "shipper", "it", 0.1), ("receiver", "consignee", "ar", 0.1), ("customs_broker", "logistics", "fr", 0.2),
)
SUBJECTS = {
    "shipper": {"en": "Documents for order {}", "it": "Documenti per ordine {}", "ar": "مستندات الطلب {}", "fr": "Documents pour la commande {}"},
    "logistics": {"en": "Transport papers, order {}", "it": "Documenti di trasporto, ordine {}", "ar": "أوراق النقل للطلب {}", "fr": "Papiers de transport, commande {}"},
    "warehouse": {"en": "Packing list, order {}"}, "consignee": {"en": "Delivery of order {}", "ar": "تسليم الطلب {}"},
}
BODIES = {
    "en": "Hello,\n\nplease find the documents for order {o}: {d}.\n\n{n}", "it": "Buongiorno,\n\nin allegato i documenti per l'ordine {o}: {d}.\n\n{n}",
    "ar": "مرحبا،\n\nمرفق مستندات الطلب {o}: {d}.\n\n{n}", "fr": "Bonjour,\n\nvoici les documents pour la commande {o} : {d}.\n\n{n}",
}
MODES = ("existing", "generated", "mixed")


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONAS, "name string, role string, language string, error_rate double")


def planned(docs: DataFrame, seed: int = 1, existing_share: float = 0.6, mode: str = "mixed") -> DataFrame:
    """One message a shipment: who would send which documents, with which subject and text; status is dry_run.

    ``docs`` has shipment, order_no and source_path. Sender and kind follow from a keyed hash of the shipment;
    in mode ``mixed`` so large a share of messages carries documents that exist, in the others all or none.
    """
    if mode not in MODES:
        raise ValueError(f"a mode is one of {MODES}")
    share = {"existing": 1.0, "generated": 0.0, "mixed": existing_share}[mode]
    draw = F.pmod(F.xxhash64(F.col("shipment"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    subject = {(role, lang): SUBJECTS[role].get(lang, SUBJECTS[role]["en"]) for _, role, lang, _ in PERSONAS}
    each = [F.struct(F.lit(n).alias("sender"), F.lit(role).alias("role"), F.lit(lang).alias("language"), F.lit(e).alias("rate"), F.lit(subject[role, lang]).alias("subject"), F.lit(BODIES[lang]).alias("body")) for n, role, lang, e in PERSONAS]
    who = F.get(F.array(*each), F.pmod(F.xxhash64(F.lit(seed), F.col("shipment")), F.lit(len(PERSONAS))).cast("int"))
    mail = docs.groupBy("shipment").agg(F.min("order_no").alias("order_no"), F.array_sort(F.collect_list("source_path")).alias("attachments"))
    mail = mail.withColumn("p", who).withColumn("o", F.coalesce("order_no", F.lit("?")))
    names = F.array_join(F.transform("attachments", lambda a: F.regexp_extract(a, r"([^/\\]*)$", 1)), ", ")
    body = F.replace(F.replace(F.replace(F.col("p.body"), F.lit("{o}"), F.col("o")), F.lit("{d}"), names), F.lit("{n}"), F.col("p.sender"))
    return mail.select(
        "shipment", "p.sender", "p.role", "p.language", F.replace(F.col("p.subject"), F.lit("{}"), F.col("o")).alias("subject"), body.alias("body"), "attachments",
        F.when(draw < share, "existing").otherwise("generated").alias("mode"), (draw < F.col("p.rate")).alias("with_error"), F.lit("dry_run").alias("status"),
    )
