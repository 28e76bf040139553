"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WORDS = f"image_id string, rotation int, pass string, word_ord int, text string, confidence double, bbox {BBOX}"
IMAGES = "image_id string, filename string, width int, height int, orientation int"
MAPPING = "row_number int, id string, weight double"
WARNINGS = "row_number int, message string"
ANCHORS = "image_id string, anchor_ord int, bbox struct<x0:double,y0:double,x1:double,y1:double,height:double>, words array<string>"
REGIONS = f"image_id string, region_ord int, bbox {BBOX}, original_text string, anchor_text string, kind string, cell_bounds struct<x0:double,x1:double>"
MATCHES = "image_id string, id string, distance int, confidence double, score double, source string, word_ords array<int>"
RESULTS = "job_id string, image_id string, status string, shipment_id string, new_weight double, reason string, processing_ms bigint"

SOURCES = (
    "ocr", "ocr_confusion_repair", "ocr_fragments", "ocr_fuzzy", "filename_exact_sheet_match", "image_header_ocr",
    "image_header_fragments", "unavailable", "mapping_match",
)
STATUSES = ("ok", "unmatched", "unsafe_weight_geometry", "partial_weight_detection", "id_matched_no_weight_region", "error")
JOB_STATUSES = ("queued", "processing", "completed", "failed")
