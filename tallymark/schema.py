"""Schemas of all stages. Every business column is nullable."""

from __future__ import annotations

RAW = "doc_id string, source_path string, source_format string, text string, tables array<array<array<string>>>, doc_ord bigint"
IDENTIFIERS = ("order_no", "bl_no", "reference", "container_no", "seal_no")
PARTIES = ("shipper", "consignee")
LOGISTICS = ("vessel", "voyage", "pol", "pod", "ship_date")
ITEM = "struct<description: string, lot: string, cartons: bigint, net_kg: double, gross_kg: double, unit_price: double, units: bigint, amount: double>"
TOTALS = "struct<cartons: bigint, net_kg: double, gross_kg: double, value: double, currency: string>"
CANONICAL = (
    "doc_id string, source_path string, doc_type string, source_format string, "
    f"identifiers struct<{', '.join(f'{c}: string' for c in IDENTIFIERS)}>, parties struct<{', '.join(f'{c}: string' for c in PARTIES)}>, "
    f"logistics struct<{', '.join(f'{c}: string' for c in LOGISTICS)}>, line_items array<{ITEM}>, totals {TOTALS}, "
    "extraction_confidence double, raw_field_labels map<string, string>, doc_ord bigint"
)
MEMBERS = "group_id string, group_rank bigint, doc_id string, doc_ord bigint, certainty double, absorbed boolean"
FINDINGS = "group_id string, field string, doc_a string, value_a string, doc_b string, value_b string, severity string, message string"
FEEDBACK = "timestamp string, shipment_id string, field string, verdict string, notes string, pipeline_verdict string, severity string, provider string, doc_type string"
ANSWER_KEY = "shipment bigint, order_no string, bl_no string, container string, has_planted_discrepancy boolean, discrepancy_in_doc_type string, discrepancy_detail array<string>"

DOC_TYPES = ("commercial_invoice", "proforma_invoice", "packing_list", "bill_of_lading", "confirmation", "unknown")
FORMATS = ("docx", "xlsx", "pdf")
SEVERITIES = ("high", "medium", "low")
