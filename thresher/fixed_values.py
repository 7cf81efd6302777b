"""These must equal the published ones for results to agree."""

# The class list, in index order; the bill classes come first.
CLASS_NAMES = (
    "receipt",
    "invoice",
    "structured_document",
    "narrative_document",
    "advertisement_presentation",
    "text_scene",
    "natural_photo",
)
BILL_CLASSES = (0, 1)
SPLITS = ("train", "val", "test")

# Ground-truth label of each source.
SOURCE_LABELS = {
    "cord_receipts": 1,
    "sroie_receipts": 1,
    "rvlcdip_invoice": 1,
    "rvlcdip_other": 0,
    "coco_photos": 0,
}

# Share of the class target and hard maximum of each source.
SOURCE_QUOTAS = (
    # name, pool_label, quota_frac, max_rows
    ("cord_receipts", "positive", 0.2, 1200),
    ("sroie_receipts", "positive", 0.2, 1200),
    ("rvlcdip_invoice", "positive", 0.6, 10000),
    ("rvlcdip_other", "negative", 0.6, 10000),
    ("coco_photos", "negative", 0.4, 10000),
)

# Document labels by negative family.
STRUCTURED_LABELS = ("budget", "file folder", "form", "questionnaire", "specification")
NARRATIVE_LABELS = (
    "email",
    "handwritten",
    "letter",
    "memo",
    "news article",
    "resume",
    "scientific publication",
    "scientific report",
)
ADVERTISEMENT_LABELS = ("advertisement", "presentation")
SCENE_LABELS = {"text scene": "text_scene", "natural photo": "natural_photo"}

# Numeric labels imported as targeted negatives.
TARGETED_LABELS = {
    5: "scientific_report",
    6: "scientific_publication",
    7: "specification",
    9: "news_article",
    10: "budget",
    12: "presentation",
    13: "questionnaire",
    14: "resume",
    15: "memo",
}

# Terms that mark a text as a receipt or bill.
RECEIPT_TERMS = (
    "amount due",
    "balance due",
    "cashier",
    "change due",
    "grand total",
    "invoice",
    "invoice no",
    "payment method",
    "receipt",
    "subtotal",
    "tax invoice",
    "total due",
    "transaction id",
)
MIN_TEXT_TOKENS = 20

# Page categories and the class each one maps to.
PAGE_CLASSES = {
    "financial_reports": (2, "structured_document"),
    "scientific_articles": (3, "narrative_document"),
    "laws_and_regulations": (3, "narrative_document"),
    "government_tenders": (2, "structured_document"),
    "manuals": (3, "narrative_document"),
    "patents": (3, "narrative_document"),
}

# Contexts, prefixes and file suffixes.
UI_CONTEXTS = ("gallery", "pdf_viewer", "email_attachment", "chat_attachment")
CAPTURE_CONTEXTS = ("direct", "screenshot")
SCREENSHOT_PREFIXES = ("data/raw/screenshot_", "screenshot:")
PROTECTED_PREFIX = "Negative/"
PUBLIC_PREFIX = "data/raw/public_hard_negatives/"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif")

# Leading bytes of the recognised image types.
PNG_MAGIC = "89504E470D0A1A0A"
JPEG_MAGIC = "FFD8FF"

# Calibration settings.
LOGIT_CLIP = 1e-6
FUSION_STEPS = 21
CUT_STEPS = 101
RECALL_TARGETS = (0.90, 0.95, 0.97, 0.99, 1.0)
ROUTE_CAPS = (0.10, 0.20, 0.30, 0.50)
LINEAR_WEIGHTS = (0.8, 0.2)
BINARY_THRESHOLD = 0.15
RECALL_FLOOR = 0.95

# Sample-weight caps and multipliers.
V2_WEIGHT_CAPS = {"bill": 8.0, "class": 5.0}
V2_PREFIX_FACTORS = {"bill": {PROTECTED_PREFIX: 2.0, PUBLIC_PREFIX: 1.35}, "class": {PROTECTED_PREFIX: 1.5}}
ROUTER_BALANCE_CAPS = {"bill": 5.0, "class": 4.0, "context": 3.0}
ROUTER_FACTOR_CAP = 6.0
ROUTER_FACTORS = {"protected": 2.0, "screenshot": 1.15}

# Column order of each manifest, all strings on disk.
FIELDS = {
    "pool": ("filepath", "source", "pool_label"),
    "labeled": ("filepath", "source", "predicted_class", "invoice_label", "confidence", "source_doc"),
    "binary_splits": ("filepath", "invoice_label", "split", "source_doc"),
    "class_splits": ("filepath", "class_index", "class_name", "split", "source_doc"),
    "forced_splits": ("filepath", "split"),
    "public_negatives": ("filepath", "source", "split", "source_doc"),
    "screenshot_negatives": (
        "filepath", "split", "source", "source_object", "episode_id", "step_id",
        "current_activity", "goal", "sha256", "width", "height",
    ),
    "screenshot_positives": (
        "filepath", "split", "parent_filepath", "source_doc", "class_index", "class_name",
        "context", "sha256",
    ),
    "pages": (
        "filepath", "split", "source_doc", "class_index", "class_name", "bill_label", "source",
        "doc_category", "collection", "doc_name", "page_no", "upstream_file", "sha256",
    ),
    "mined": ("filepath", "score"),
}
FIELD_TYPES = {
    "invoice_label": "int",
    "confidence": "double",
    "class_index": "int",
    "bill_label": "int",
    "step_id": "int",
    "page_no": "int",
    "width": "int",
    "height": "int",
    "score": "double",
}
OPERATING_TARGET = 0.995
