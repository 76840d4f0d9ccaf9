"""Row types, entity dimension and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: entity types, categories, redaction tokens -----------------
# (entity_type, category, redaction token)
ENTITIES = [
    ("EMAIL", "PII", "[REDACTED_EMAIL]"),
    ("PHONE", "PII", "[REDACTED_PHONE]"),
    ("SSN", "PII", "[REDACTED_SSN]"),
    ("CREDIT_CARD", "PII", "[REDACTED_CC]"),
    ("AWS_KEY", "SECRET", "[REDACTED_SECRET]"),
    ("GITHUB_TOKEN", "SECRET", "[REDACTED_SECRET]"),
    ("JWT", "SECRET", "[REDACTED_SECRET]"),
    ("PASSWORD", "SECRET", "[REDACTED_SECRET]"),
    ("PERSON_NAME", "PII", "[REDACTED_NAME]"),
    ("GENERIC_PII", "PII", "[REDACTED_PII]"),
    ("GENERIC_SECRET", "SECRET", "[REDACTED_SECRET]"),
]

# --- Fixed values: regex pass (entity_type, pattern, confidence) --------------
# Written for Python's `re`; `functions.text.java_regex` gives the JVM form.
PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.95),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.95),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", 0.99),
    ("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b", 0.95),
    ("GITHUB_TOKEN", r"\b(ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,})\b", 0.95),
    (
        "JWT",
        r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
        0.95,
    ),
]

# --- Fixed values: default policy (entity_type, action, min_confidence) -------
POLICY_ID = "default-v1"
DEFAULT_RULES = [
    ("EMAIL", "MASK", 0.7),
    ("PHONE", "MASK", 0.7),
    ("SSN", "MASK", 0.5),
    ("CREDIT_CARD", "MASK", 0.8),
    ("PERSON_NAME", "MASK", 0.85),
    ("GENERIC_PII", "MASK", 0.7),
    ("AWS_KEY", "BLOCK", 0.5),
    ("GITHUB_TOKEN", "BLOCK", 0.5),
    ("JWT", "BLOCK", 0.7),
    ("PASSWORD", "BLOCK", 0.6),
    ("GENERIC_SECRET", "BLOCK", 0.90),
]
DEFAULT_MIN_CONFIDENCE = 0.5
SEVERITY = ["ALLOW", "MASK", "BLOCK"]  # ascending

# --- Fixed values: detector priorities and the short-circuit threshold --------
DETECTOR_PRIORITY = {"regex": 1, "presidio": 2, "semantic": 3}
CONCLUSIVE_DETECTOR, CONCLUSIVE_CONFIDENCE = "regex", 0.85

# --- Fixed values: label maps of the two model passes -------------------------
CONTEXTUAL_LABELS = [
    ("EMAIL_ADDRESS", "EMAIL"),
    ("PHONE_NUMBER", "PHONE"),
    ("US_SSN", "SSN"),
    ("CREDIT_CARD", "CREDIT_CARD"),
    ("PERSON", "PERSON_NAME"),
    ("US_BANK_NUMBER", "GENERIC_PII"),
    ("US_PASSPORT", "GENERIC_PII"),
    ("US_DRIVER_LICENSE", "GENERIC_PII"),
    ("IP_ADDRESS", "GENERIC_PII"),
]
SEMANTIC_LABELS = [("PII", "GENERIC_PII"), ("SECRET", "GENERIC_SECRET")]
BIO_LABELS = ["O", "B-PII", "I-PII", "B-SECRET", "I-SECRET"]
IGNORE_LABEL = -100
MAX_TOKENS = 128

# --- Fixed values: histogram bounds -------------------------------------------
CONFIDENCE_BOUNDS = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99, 1.0]
LATENCY_BOUNDS = {  # seconds
    "detection": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.5, 1.0],
    "llm": [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0],
    "request": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0],
}

ENTITY_TYPES = [e for e, _, _ in ENTITIES]
CATEGORY_OF = {e: c for e, c, _ in ENTITIES}
TOKEN_OF = {e: t for e, _, t in ENTITIES}

FINDING = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("matched_text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detector", T.StringType()),
    ]
)
FINDINGS = T.ArrayType(FINDING)
COUNTS = T.MapType(T.StringType(), T.LongType())
RULE_MAP = "map<string,struct<action:string,min_confidence:double>>"

# The columns of an audit row.
AUDIT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_decision", T.StringType()),
        T.StructField("output_decision", T.StringType()),
        T.StructField("policy_id", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("input_redactions", COUNTS),
        T.StructField("output_redactions", COUNTS),
        T.StructField("prompt_redacted", T.StringType()),
        T.StructField("response_redacted", T.StringType()),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("detection_latency_ms", T.IntegerType()),
        T.StructField("llm_latency_ms", T.IntegerType()),
        T.StructField("total_latency_ms", T.IntegerType()),
    ]
)

# The fields of a message; others are kept as `extra`.
MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tool_call_id", T.StringType()),
    ]
)

LABELED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("label", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

TOKEN_SCORES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("logits", T.ArrayType(T.DoubleType())),
        ]
    )
)

# The fields of a streamed chunk.
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("created", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField(
            "choices",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("index", T.IntegerType()),
                        T.StructField(
                            "delta",
                            T.StructType([T.StructField("content", T.StringType())]),
                        ),
                        T.StructField("finish_reason", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
