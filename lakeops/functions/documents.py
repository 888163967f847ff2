"""Document payloads and the paths of the files made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PDF_MAGIC = b"%PDF-"
RTF_MAGIC = b"{\\rtf"


def base64_padding(c: Column) -> Column:
    """Number of padding characters of a base64 text."""
    return F.length(c) - F.length(F.replace(c, F.lit("="), F.lit("")))


def strict_base64(c: Column) -> Column:
    """Bytes of a text that holds nothing but base64 and line breaks; null for anything else.

    One pass over the text, but it takes text whose padding is missing: see ``padded_enough``.
    """
    return F.try_to_binary(c, F.lit("base64"))


def padded_enough(raw: Column, padding: Column) -> Column:
    """Whether bytes decoded from unbroken base64 came with the padding their length calls for."""
    over = F.length(raw) % 3
    return (over == 0) | ((over == 1) & (padding >= 2)) | ((over == 2) & (padding >= 1))


def lenient_base64(c: Column, padding: Column) -> Column:
    """Bytes of a base64 text with foreign ASCII characters in it, which are left out.

    Surplus padding is accepted. Missing padding, a dangling symbol or a character outside ASCII make
    it null.
    """
    symbols = F.regexp_replace(c, "[^A-Za-z0-9+/]", "")
    tail = F.length(symbols) % 4
    decodable = (tail == 0) | ((tail == 2) & (padding >= 2)) | ((tail == 3) & (padding >= 1))
    missing = F.when(tail == 2, "==").when(tail == 3, "=").otherwise("")
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only & decodable, F.unbase64(F.concat(symbols, missing)))


def document_format(raw: Column) -> Column:
    """``pdf``, ``rtf`` or ``other`` from the first five bytes."""
    head = F.substring(raw, 1, 5)
    return F.when(head == F.lit(PDF_MAGIC), "pdf").when(head == F.lit(RTF_MAGIC), "rtf").otherwise("other")


def sanitize_id(c: Column) -> Column:
    """Id as a single path segment."""
    return F.regexp_replace(c, "[^A-Za-z0-9._]", "_")


def _day_folder(day: Column) -> Column:
    return F.date_format(F.to_date(F.substring(day, 1, 10), "yyyy-MM-dd"), "yyyy/MM/dd")


def tree_path(template: Column, day: Column, doc_id: Column, index: Column | None = None) -> Column:
    """Fill ``{{date}}``, ``{{hl7_id}}`` and, where an index is given, ``{{table_no}}``."""
    path = F.replace(template, F.lit("{{date}}"), _day_folder(day))
    path = F.replace(path, F.lit("{{hl7_id}}"), sanitize_id(doc_id))
    if index is None:
        return path
    return F.when(index.isNull(), path).otherwise(F.replace(path, F.lit("{{table_no}}"), index.cast("string")))


def day_prefix(template: Column, day: Column) -> Column:
    """Folder holding every file of a day: the template up to the id, without a trailing slash."""
    head = F.split_part(template, F.lit("{{hl7_id}}"), F.lit(1))
    return F.rtrim(F.replace(head, F.lit("{{date}}"), _day_folder(day)), F.lit("/"))


def uri_bucket(uri: Column) -> Column:
    return F.regexp_extract(uri, "^[^:]*://([^/]*)", 1)


def uri_key(uri: Column) -> Column:
    return F.regexp_extract(uri, "^[^:]*://[^/]*/*(.*?)/*$", 1)
