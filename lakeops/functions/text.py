"""Cleaning of string columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sheet cells read as missing. `NA`, `None` and `null` are data and stay.
SHEET_NA = [
    "-1.#IND", "1.#QNAN", "1.#IND", "-1.#QNAN", "#N/A N/A", "#N/A", "N/A", "n/a", "<NA>", "#NA", "NULL",
    "NaN", "-NaN", "nan", "-nan", "",
]

# Fixed value: control characters a spreadsheet cell cannot hold.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

# Blank characters trimmed from sheet cells (Unicode white space plus the four ASCII separators).
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def map_strings(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Apply ``change`` to every string column; other types pass through."""
    return df.select([
        change(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def strip_illegal(df: DataFrame) -> DataFrame:
    return map_strings(df, lambda c: F.regexp_replace(c, ILLEGAL, ""))


def clean_sheet(df: DataFrame, na_tokens: list[str] | None = None) -> DataFrame:
    """Missing tokens to null, blanks trimmed, then line breaks and tabs removed.

    The token test sees the untouched cell, so ``' x '`` is trimmed but ``' NULL '`` is not missing.
    Two-character escapes go before real breaks: removing a break must not create a new escape.
    """
    tokens = SHEET_NA if na_tokens is None else na_tokens

    def clean(c: Column) -> Column:
        kept = F.when(~c.isin(tokens), c)
        trimmed = F.btrim(kept, F.lit(BLANKS))
        unescaped = F.when(trimmed.contains("\\"), F.regexp_replace(trimmed, r"\\[tnr]", "")).otherwise(trimmed)
        return F.translate(unescaped, "\t\n\r", "")

    return map_strings(df, clean)


def _folding() -> tuple[str, str]:
    """Latin letters whose decomposition is one ASCII letter plus marks."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)
        base = "".join(ch for ch in base if not unicodedata.combining(ch))
        if len(base) == 1 and base.isascii() and letter == letter.lower():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _folding()
# Letters that fold to themselves without a mark, or to two letters.
_STROKED, _UNSTROKED = "øđłħŧı", "odlhti"
_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"}


def fold_keyword(c: Column) -> Column:
    """Lower case with accents folded to ASCII, the way keyword fields are compared."""
    folded = F.translate(F.lower(c), _ACCENTED + _STROKED, _PLAIN + _UNSTROKED)
    for letter, plain in _LIGATURES.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded
