"""Files: validation, text of documents, registration for ingest."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import fixed_values as fv
from foliary.functions.text import base_name, extension, file_type, safe_file_name, strip


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def detected_type(content: Column) -> Column:
    """Type by leading bytes; text that decodes as UTF-8 without zero bytes is
    plain text."""
    head = F.hex(F.substring(content, 1, 8))
    text = content.cast("string")
    kind = F.when(
        F.is_valid_utf8(text) & ~text.contains("\u0000"), "text/plain"
    ).otherwise("application/octet-stream")
    for magic, label in reversed(fv.MAGIC_NUMBERS):
        kind = F.when(head.startswith(magic), label).otherwise(kind)
    return kind


def validation_report(files: DataFrame) -> DataFrame:
    """``valid`` flag and list of errors of each file (path, length, content)."""
    ext = extension(F.col("path"))
    expected = F.create_map(*[F.lit(x) for kv in fv.EXPECTED_TYPE.items() for x in kv])
    prepared = files.withColumns(
        {
            "filename": safe_file_name(F.col("path")),
            "extension": ext,
            "detected_type": detected_type(F.col("content")),
            "content_hash": F.sha2("content", 256),
        }
    )
    text = F.lower(F.decode("content", "ISO-8859-1"))
    dangerous = F.lit(False)
    for pattern in fv.DANGEROUS_CONTENT:
        dangerous = dangerous | text.contains(pattern)
    wanted = F.try_element_at(expected, F.col("extension"))
    errors = F.array_compact(
        F.array(
            F.when(~F.col("extension").isin(fv.ALLOWED_UPLOADS), "file type not allowed"),
            F.when(F.col("length") > fv.MAX_UPLOAD_BYTES, "file too large"),
            F.when(wanted != F.col("detected_type"), "content does not match extension"),
            F.when(dangerous, "potentially malicious content"),
        )
    )
    return prepared.withColumn("errors", errors).select(
        "path",
        "filename",
        F.col("length").alias("actual_size"),
        "content_hash",
        "detected_type",
        (F.size("errors") == 0).alias("valid"),
        "errors",
    )


# --- text ------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(node) -> str:
    out = []
    for part in node.iter():
        if part.tag == f"{_W}t":
            out.append(part.text or "")
        elif part.tag == f"{_W}tab":
            out.append("\t")
        elif part.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def word_text(content: bytes) -> str:
    """Non-blank paragraphs, then table rows with cells joined by `` | ``."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, OSError):
        return ""
    if body is None:
        return ""
    lines = [t for t in (_paragraph(p) for p in body.findall(f"{_W}p")) if t.strip()]
    for row in body.findall(f"{_W}tbl/{_W}tr"):
        cells = [
            "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")).strip()
            for cell in row.findall(f"{_W}tc")
        ]
        if any(cells):
            lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def _word_texts(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: word_text(bytes(b)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _plain_texts(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: bytes(b).decode("utf-8", errors="ignore"), na_action="ignore")


def extract_texts(files: DataFrame) -> DataFrame:
    """Adds ``file_type`` and ``extracted_text``; text only for plain-text and
    Word files, '' for all others.  Clean UTF-8 is cast inside the JVM."""
    kind = F.col("file_type")
    as_text = F.col("content").cast("string")
    typed = files.withColumn("file_type", file_type(F.col("path")))
    word = F.when(kind == "document", F.col("content"))
    broken = F.when((kind == "text") & ~F.is_valid_utf8(as_text), F.col("content"))
    read = typed.withColumns({"_word": _word_texts(word), "_broken": _plain_texts(broken)})
    return read.withColumn(
        "extracted_text",
        F.when(kind == "document", F.col("_word"))
        .when(kind == "text", F.coalesce("_broken", as_text))
        .otherwise(""),
    ).drop("_word", "_broken")


def unreadable(extracted: DataFrame) -> DataFrame:
    """Files other than images and PDF without any text: an error."""
    return extracted.filter(
        (strip(F.col("extracted_text")) == "") & ~F.col("file_type").isin("image", "pdf")
    )


def readable(extracted: DataFrame) -> DataFrame:
    return extracted.filter(
        (strip(F.col("extracted_text")) != "") | F.col("file_type").isin("image", "pdf")
    )


def ingest_rows(files: DataFrame) -> DataFrame:
    """Catalog rows of new PDF files, QUEUED."""
    return files.filter(extension(F.col("path")) == ".pdf").select(
        F.col("path").alias("file_id"),
        base_name(F.col("path")).alias("filename"),
        F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("content_hash"),
        F.lit("QUEUED").alias("status"),
        F.col("modificationTime").alias("created_at"),
    )

