"""Compressed image objects."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

# Layout of a compressed object and of the file inside it.
HEADER_BYTES = 8
MAGIC = b"DICM"
MAGIC_OFFSET = 128


def inflated(blob: bytes | None) -> tuple[bytes | None, str | None]:
    """Content and error of a compressed object; one of them is null."""
    try:
        content = zlib.decompress(bytes(blob)[HEADER_BYTES:])
    except (zlib.error, TypeError) as bad:
        return None, f"inflate: {bad}"
    if content[MAGIC_OFFSET:MAGIC_OFFSET + len(MAGIC)] != MAGIC:
        return None, "no DICM marker after inflating"
    return content, None


@F.pandas_udf(StructType().add("content", BinaryType()).add("error", StringType()))
def inflate(payload: pd.Series) -> pd.DataFrame:
    """Inflate objects; a bad one yields a null content and an error, never an exception."""
    return pd.DataFrame([inflated(blob) for blob in payload], columns=["content", "error"])
