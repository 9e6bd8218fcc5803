"""Constants that are committed, not passed as flags."""

from __future__ import annotations

#: Fixed values.
SIMILARITY_FLOOR = 0.4364
DEFAULT_K = 6
MIN_SUBJECT_OVERLAP = 2
EMBEDDING_USD_PER_MILLION = 0.06
INPUT_USD_PER_MILLION = 5.00
OUTPUT_USD_PER_MILLION = 25.00
PRICES_AS_OF = "2026-08-27"
HASH_DIMENSIONS = 512
SCHEMA_VERSION = 2
BOUNDARY_LOWEST, BOUNDARY_HIGHEST = 3, 5
#: The keys of a document's frontmatter.
FRONTMATTER_KEYS = ("id", "title", "docType", "effectiveDate", "version")
#: Words that are neither units nor subjects.
STOPWORDS = (
    "the a an and or of to in on at for from by with per is are was were be been that this these those it its as not no any all "
    "each must may can will shall within after before than then when which who whom into over under up out"
).split()
#: Kinds of rejected claims, in the order of the checks.
REJECTION_KINDS = (
    "malformed-claim",
    "empty-claim-text",
    "empty-citations",
    "duplicate-citation",
    "stated-claim-multiple-citations",
    "inferred-claim-single-citation",
    "empty-quote",
    "quote-for-uncited-chunk",
    "chunk-not-retrieved",
    "quote-not-in-chunk",
    "citation-without-quote",
)
#: Outcomes a question may ask for, and the failures that head a report.
OUTCOMES = ("refused-no-documents", "refused-contradiction", "answered")
HEADLINE_KINDS = ("hallucinated-answer", "resolved-contradiction")
#: Category -> (label, share of questions that must pass)
GATE = {
    "refused-no-documents": ("must-refuse (no documents)", 1.0),
    "refused-contradiction": ("must-refuse (contradiction)", 1.0),
    "answered": ("answerable", 0.8),
}
