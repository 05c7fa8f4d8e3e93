"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

USAGE = "tool string, action string, template string"
CONVERSION = "tool string, status string, inputBytes long, outputBytes long, pages int, durationMs long, errorCode string"
FEEDBACK = "rating int, comment string, template string, format string, tool string"

#: The members of each closed list.
TOOLS = ["resume", "law", "pdf-to-word", "word-to-pdf", "gym"]
ACTIONS = ["open", "coming_soon_click", "upload", "parse_upload", "generate", "convert", "convert_failed", "search", "search_failed", "load_more", "download_pdf", "download_docx"]
SERVER_ONLY = ["parse_upload", "generate", "convert", "convert_failed", "search", "search_failed", "load_more"]
TEMPLATES = ["classic", "modern", "compact"]
FORMATS = ["pdf", "docx"]
STATUSES = ["success", "failed"]

OPINION = T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("snippet", T.StringType())])
HIT = T.StructType(
    [
        T.StructField("cluster_id", T.LongType()),
        T.StructField("caseName", T.StringType()),
        T.StructField("court_id", T.StringType()),
        T.StructField("dateFiled", T.StringType()),
        T.StructField("citation", T.ArrayType(T.StringType())),
        T.StructField("opinions", T.ArrayType(OPINION)),
    ]
)
