"""Column helpers that reproduce Python string semantics with native Spark
expressions (no UDF): strip, whitespace split, all-caps test, capitalize."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not only blanks."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def strip_chars(c, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a literal character set."""
    cls = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars)
    return F.regexp_replace(col(c), f"^[{cls}]+|[{cls}]+$", "")


def lstrip_chars(c, chars: str) -> Column:
    cls = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars)
    return F.regexp_replace(col(c), f"^[{cls}]+", "")


def collapse_ws(c) -> Column:
    """Runs of whitespace become one blank."""
    return F.regexp_replace(col(c), r"\s+", " ")


def ws_tokens(c) -> Column:
    """Python ``str.split()``: whitespace tokens, no empty pieces."""
    return F.filter(F.split(py_strip(c), r"\s+"), lambda t: F.length(t) > 0)


def n_ws_tokens(c) -> Column:
    return F.size(ws_tokens(c))


def py_isupper(c) -> Column:
    """Python ``str.isupper()``: some upper-case letter and no lower/title-case one."""
    x = col(c)
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")


def py_capitalize(c) -> Column:
    """Python ``str.capitalize()``: first character upper, the rest lower."""
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))
