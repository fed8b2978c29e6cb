"""Author-name Column functions (B10-B13, H1-H5), all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import (
    col, collapse_ws, n_ws_tokens, py_capitalize, py_isupper, py_strip, strip_chars,
)

# Substrings that send a byline to the entity model.  The
# missing comma after "Today" is the reference's own list: it makes one entry
# "Todayguest", which can never match lower-cased text.
GATE_KEYWORDS = (
    "editorial", "press", "news", "bureau", "staff", "team", "times", "media",
    "university", "school", "department", "foundation", "center", "centre",
    "institute", "committee", "council", "network", "desk", "journal", "Todayguest",
    "contributor", "columnist", "reporter", "editor", "journalist",
    ";", " and ", "/", "with", "by",
)
# Symbols that also send a byline to the entity model.
GATE_SYMBOLS = (";", "/", " and ", "#")
# Junk substrings that make a final author name invalid.
JUNK_TERMS = ("foundation", "team", "house", "board", "reporters")


def needs_entity_model(c, fix_keywords: bool = False) -> Column:
    """True for bylines the simple ';' split cannot handle.

    ``fix_keywords`` splits the merged "Todayguest" entry into its two
    intended keywords (Q1)."""
    x = col(c)
    low = F.lower(x)
    kws = list(GATE_KEYWORDS)
    if fix_keywords:
        kws.remove("Todayguest")
        kws += ["today", "guest"]
    hit = F.lit(False)
    for kw in kws:
        hit = hit | low.contains(kw)
    sym = F.lit(False)
    for s in GATE_SYMBOLS:
        sym = sym | x.contains(s)
    too_short = F.length(py_strip(x)) < 5
    too_long = n_ws_tokens(x) > 6
    return F.coalesce(hit | py_isupper(x) | too_short | too_long | sym, F.lit(False))


def fix_caps(c) -> Column:
    """H1: all-caps tokens become capitalised, others stay; one blank
    between tokens (the documented intent, Q4)."""
    toks = F.split(py_strip(col(c)), r"\s+")
    fixed = F.transform(toks, lambda t: F.when(py_isupper(t), py_capitalize(t)).otherwise(t))
    return F.array_join(fixed, " ")


def split_byline(c) -> Column:
    """H2: ';'-separated names, stripped, empties dropped, caps fixed."""
    parts = F.transform(F.split(col(c), ";"), lambda p: py_strip(p))
    parts = F.filter(parts, lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: fix_caps(p))


def is_multi_token(c) -> Column:
    """More than one whitespace token."""
    return n_ws_tokens(c) > 1


def uninvert_name(c, collapse: bool = True) -> Column:
    """H3/H4: ``Last, First; rest`` -> ``First Last rest``.

    The part after the first ', ' is cut at its first ';'; what follows that
    ';' and any third ', ' part form the rest (Q9: it goes last).  Names
    without ', ' pass through.  ``collapse`` applies the whitespace collapse
    the reference runs only when some name in the table has a comma."""
    x = col(c)
    parts = F.split(x, ", ")
    p0, p1, p2 = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    s1 = F.split(p1, ";", 2)
    first = py_strip(F.get(s1, 0))
    rest = strip_chars(F.concat(F.coalesce(py_strip(F.get(s1, 1)), F.lit("")), F.lit("; "),
                                F.coalesce(p2, F.lit(""))), "; ")
    name = F.when(p1.isNull(), p0).otherwise(
        F.concat(strip_chars(first, ".;"), F.lit(" "), strip_chars(p0, ";. "), F.lit(" "),
                 strip_chars(rest, ";.")))
    if collapse:
        return py_strip(collapse_ws(name))
    return py_strip(x)


def is_valid_author(c) -> Column:
    """At least two tokens, not all caps, no ``| / #``, no junk term.
    (The exact-word reject set of the reference is unreachable, Q3.)"""
    x = py_strip(col(c))
    low = F.lower(x)
    junk = F.lit(False)
    for t in JUNK_TERMS:
        junk = junk | low.contains(t)
    ok = (n_ws_tokens(x) >= 2) & ~py_isupper(x) & ~x.rlike(r"[|/#]") & ~junk
    return F.coalesce(ok, F.lit(False))
