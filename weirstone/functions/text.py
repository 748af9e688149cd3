"""Text expressions: whitespace, and Unicode compatibility normalisation (NFKC) in Catalyst.

Spark has no NFKC. A rule splits the characters in two: those that NFKC maps to themselves or to one
other character go through ``translate`` in the JVM; texts with any other character (expansions,
combining marks) alone are sent to Python.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: The characters of Unicode property White_Space and the four separators Python counts too, for a Java character class.
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HARD = "\uffff"


@functools.cache
def nfkc_tables() -> tuple[str, str]:
    """(from, to) for translate: one-to-one mappings, then every character that needs more, mapped to a noncharacter."""
    src, dst = [], []
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0xFFFF), *range(0x10000, 0x30000)):
        ch = chr(cp)
        n = unicodedata.normalize("NFKC", ch)
        if len(n) != 1 or unicodedata.category(ch) in ("Mn", "Mc") or 0x1100 <= cp < 0x1200 or unicodedata.combining(n):
            src.append(ch)
            dst.append(_HARD)
        elif n != ch:
            src.append(ch)
            dst.append(n)
    return "".join(src), "".join(dst)


@F.pandas_udf(StringType())
def _nfkc_python(s: pd.Series) -> pd.Series:
    out = s.copy()
    at = s.notna()
    if at.any():
        out[at] = [unicodedata.normalize("NFKC", x) for x in s[at]]
    return out


def nfkc(text: Column) -> Column:
    """NFKC of a column; null stays null."""
    easy = F.translate(text, *nfkc_tables())
    hard = easy.contains(_HARD)
    return F.when(hard, _nfkc_python(F.when(hard, text))).otherwise(easy)


def squeeze_all(text: Column) -> Column:
    """Without any white space, in lower case."""
    return F.lower(F.regexp_replace(text, f"[{SPACES}]+", ""))


def strip(text: Column) -> Column:
    """Python's strip(): Unicode white space off both ends."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def line_key(line: str) -> str:
    """The plain-Python form of squeeze_all(nfkc(line)), for tests and small fixtures."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", line)).lower()
