"""Fixed vocabularies, explicit schemas and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Statuses in their order, which lists are sorted by.
STATUSES = ("UPLOADED", "PROCESSING", "AUTO_APPROVED", "REVIEW_REQUIRED", "APPROVED", "REJECTED", "POSTED", "FAILED")
# Which status may follow which.
TRANSITIONS = {
    "UPLOADED": ("PROCESSING", "FAILED"),
    "PROCESSING": ("AUTO_APPROVED", "REVIEW_REQUIRED", "FAILED"),
    "AUTO_APPROVED": ("POSTED", "FAILED"),
    "REVIEW_REQUIRED": ("APPROVED", "REJECTED", "PROCESSING"),
    "APPROVED": ("POSTED", "FAILED"),
    "REJECTED": (),
    "POSTED": (),
    "FAILED": ("PROCESSING",),
}
# Statuses of a view, of the review queue, of finished work.
FINALIZED = ("APPROVED", "POSTED")
IN_REVIEW = ("PROCESSING", "REVIEW_REQUIRED", "FAILED", "REJECTED")
DONE = ("AUTO_APPROVED", "APPROVED", "POSTED")
POSTABLE = ("AUTO_APPROVED", "APPROVED")
#: What a reviewer's action leads to.
ACTIONS = {"APPROVE": "APPROVED", "REJECT": "REJECTED", "REPROCESS": "PROCESSING"}

# The fields that two extractions are compared on.
COMPARED = ("vendor_name", "invoice_number", "invoice_date", "total_amount", "subtotal", "tax_amount", "purchase_order")
MONEY = ("total_amount", "subtotal", "tax_amount")

# Business fields, from which labels O, B-X, I-X are made in this order.
FIELDS = (
    "vendor_name", "vendor_address", "vendor_phone", "vendor_email", "vendor_tax_id", "invoice_number", "invoice_date", "due_date",
    "purchase_order", "currency", "subtotal", "tax_amount", "gst", "igst", "cgst", "total_quantity", "total_amount",
    "terms_and_conditions", "line_item_description", "line_item_quantity", "line_item_unit_price", "line_item_amount",
)
LABELS = ("O", *(f"{p}-{f.upper()}" for f in FIELDS for p in "BI"))
# How fields are grouped for display.
GROUPS = {
    "A. Basic Information": ("sno", "invoice_number", "invoice_date", "purchase_order"),
    "B. Vendor Details": ("vendor_name", "vendor_address", "vendor_phone", "vendor_email"),
    "C. Financial Details": ("total_quantity", "gst", "igst", "cgst", "total_amount"),
    "D. Additional Information": ("terms_and_conditions",),
}
# Fields whose values are compared loosely, and as numbers.
FUZZY_FIELDS = ("vendor_name", "vendor_address", "line_item_description")
NUMERIC_FIELDS = ("subtotal", "tax_amount", "total_amount", "line_item_unit_price", "line_item_amount", "line_item_quantity")
# US dollars for one unit, and symbols.
RATES = {"USD": 1.0, "EUR": 1.08, "JPY": 0.0065, "INR": 0.012}
SYMBOLS = {"USD": "$", "EUR": "€", "JPY": "¥", "INR": "₹"}
# What may be uploaded.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tiff", "tif")
MAX_BYTES = 25 * 1024 * 1024


@dataclass(frozen=True)
class Thresholds:
    confidence: float = 0.85
    field_match: float = 0.90
    amount_tolerance: str = "0.01"
    champ_weight: float = 0.65
    challenger_weight: float = 0.35
    similarity: float = 0.9


DEFAULTS = Thresholds()

BOX = T.ArrayType(T.IntegerType())
EXAMPLE = T.StructType(
    [
        T.StructField("image", T.StringType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("bboxes", T.ArrayType(BOX)),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("image_size", T.ArrayType(T.IntegerType())),
    ]
)
