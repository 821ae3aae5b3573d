"""Accent folding: compatibility decomposition without combining marks.

The tables are generated from Unicode data. One-to-one and deleting entries run
as a native ``translate``; the rare characters that expand to several (ligatures,
fractions, Hangul) go through an Arrow UDF that receives null for every other row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonemill.functions.text import is_ascii


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str]:
    """(characters to replace, replacements, regex class of expanding characters)."""
    single: list[tuple[str, str]] = []
    deleted: list[str] = []
    expanding: list[int] = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = fold(char)
        if folded == char:
            continue
        if not folded:
            deleted.append(char)
        elif len(folded) == 1:
            single.append((char, folded))
        else:
            expanding.append(code)
    ranges: list[list[int]] = []
    for code in expanding:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    body = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    source = "".join(c for c, _ in single) + "".join(deleted)
    target = "".join(f for _, f in single)
    return source, target, f"[{body}]"


def _fold_udf() -> Callable[[Column], Column]:
    # A nested function is shipped by value, so executors need no copy of this package.
    def fold_series(texts: pd.Series) -> pd.Series:
        import unicodedata

        def fold_one(text: str) -> str:
            return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

        return texts.map(fold_one, na_action="ignore")

    return F.pandas_udf(fold_series, StringType())


def fold_accents(text: Column, expand: bool = True) -> Column:
    """Fold accents; ``expand=False`` skips the multi-character decompositions and stays in the JVM.

    Pass a plain column: it is tested, translated and shipped, and an expression
    would be evaluated for each of these.
    """
    source, target, expanding = _tables()
    native = F.when(is_ascii(text), text).otherwise(F.translate(text, source, target))
    if not expand:
        return native
    # Latin letters are ruled out by a cheap range test before the long class is tried.
    needs = ~is_ascii(text) & text.rlike(r"[\xa0-\xbf\x{130}-\x{10ffff}]") & text.rlike(expanding)
    return F.coalesce(_fold_udf()(F.when(needs, text)), native)
