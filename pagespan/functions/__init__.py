"""Scalar semantics: text, URLs, pages, robots rules, redaction, native columns."""
