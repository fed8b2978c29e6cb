"""Degree wording: patterns, sentence split, context spans (B17, B18, B25,
H25, H26, E4, G1).

Patterns are matched on a *word-class-preserving* copy of the text: every
non-ASCII letter becomes ``x`` and every non-ASCII digit ``0``.  Lengths and
word boundaries stay the same as Python's Unicode ``\\b`` sees them, and the
patterns themselves are plain ASCII, so every regex engine agrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col, py_strip

# The shipped strict degree pattern, flattened from its
# verbose form (abbreviations on word boundaries, full names, "graduated").
STRICT = (r"(?i)(?:\bB\.?A\.?\b|\bA\.?B\.?\b|\bB(?:Sc|\.?S\.?|Sc)\b|\bM\.?A\.?\b|\bM(?:Sc|\.?S\.?|Sc)\b"
          r"|\bPh\.?D\.?s?\b|\bJ\.?D\.?s?\b|\bL\.?L\.?M\.?s?\b)"
          r"|(?:\bBachelor(?:'s)?\b|\bMaster(?:'s)?\b|\bDoctorate\b)"
          r"|(?:\bgraduated\b)")
# The shipped loose pattern (abbreviations without boundaries, Q5).
LOOSE = (r"(?i)(?:\b(?:degree|degrees|graduating|Bachelor(?:'s)?|Master(?:'s)?|Doctorate)\b"
         r"|BA|A\.?B\.?|BS|B\.?S\.?|MA|M\.?A\.?|MS|M\.?S\.?|Ph\.?D\.?|J\.?D\.?|L\.?L\.?M\.?)")
# The notebook's alternative strict pattern (B25), with its
# look-around, so that matches have the right extent.
NOTEBOOK = (r"(?i)(?:(?<!\.)\bB\.?(?:A|S|Sc|F\.A|B\.A|Phil)(?=\s|\.|$)"
            r"|(?<!\.)\bM\.?(?:A|S|Sc|Res|Phil|F\.A|B\.A|Ed)(?=\s|\.|$)"
            r"|(?<!\.)\b(?:Ph|J|M|Ed|Sc|D|LL)\.?D(?=\s|\.|$))"
            r"|(?:\bBachelor of (?:Arts|Science|Fine Arts|Philosophy|Laws)\b"
            r"|\bMaster of (?:Arts|Science|Research|Philosophy|Education|Laws)\b"
            r"|\bDoctor of (?:Philosophy|Science|Medicine|Engineering)\b"
            r"|\bJuris Doctor\b|\bDr\.?\s*rer\.?\s*nat\b)")
PATTERNS = {"strict": STRICT, "loose": LOOSE, "notebook": NOTEBOOK}

# Title abbreviations that never end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc")
KEEP = "\u0002"
CUT = "\u0001"
PROTECT = r"(^|[\s(\[\"'])(" + "|".join(ABBREVIATIONS) + r"|\p{Lu})\.(\s)"
BOUNDARY = r"([.!?]+[\"')\]]*)\s+([\p{Lu}\p{Nd}])"


def word_safe(c) -> Column:
    """Non-ASCII letters -> 'x', non-ASCII digits -> '0' (same length)."""
    x = F.regexp_replace(col(c), r"[^\x00-\x7F\P{L}]", "x")
    return F.regexp_replace(x, r"[^\x00-\x7F\P{N}]", "0")


def mentions(c, kind: str = "strict") -> Column:
    return word_safe(c).rlike(PATTERNS[kind])


def sentences(c) -> Column:
    """Sentence split.  A boundary is ``.``/``!``/``?`` (plus closing
    quotes or brackets), blanks, then an upper-case letter or digit - unless
    the period ends a listed title abbreviation or a one-letter initial."""
    x = col(c)
    for _ in range(2):  # two passes: neighbouring abbreviations share a blank
        x = F.regexp_replace(x, PROTECT, "$1$2" + KEEP + "$3")
    x = F.regexp_replace(x, BOUNDARY, "$1" + CUT + "$2")
    parts = F.transform(F.split(x, CUT), lambda s: py_strip(F.replace(s, F.lit(KEEP), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) > 0)


def sentence_windows(sents, window: int = 1, kind: str = "strict") -> Column:
    """For every matching sentence, it and ``window`` neighbours on each
    side (clipped) joined by a blank; duplicates dropped in order (G1)."""
    s = col(sents)
    idx = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))),
                   lambda i: (F.size(s) > 0) & mentions(F.element_at(s, i), kind))
    chunks = F.transform(idx, lambda i: py_strip(F.array_join(
        F.slice(s, F.greatest(i - window, F.lit(1)), F.least(i + window, F.size(s)) - F.greatest(i - window, F.lit(1)) + 1),
        " ")))
    return F.array_distinct(chunks)


def char_spans(c, chars: int = 100, kind: str = "strict") -> Column:
    """Every match +- ``chars`` characters, clipped, stripped, distinct
    in order.  Offsets come from the split pieces and the match lengths.
    (``match_parts`` + ``spans_from_parts`` do the same in two projections,
    which evaluates each regex once per row.)"""
    pieces, found = match_parts(c, kind)
    return spans_from_parts(c, pieces, found, chars)


def match_parts(c, kind: str = "strict") -> tuple[Column, Column]:
    """(pieces between matches, matches) of the word-safe copy of ``c``."""
    safe = word_safe(c)
    pat = PATTERNS[kind]
    return F.split(safe, pat, -1), F.regexp_extract_all(safe, F.lit(pat), 0)


def spans_from_parts(text, pieces, found, chars: int = 100) -> Column:
    text, pieces, found = col(text), col(pieces), col(found)
    n = F.size(found)
    plen = F.transform(pieces, lambda p: F.length(p))
    mlen = F.transform(found, lambda m: F.length(m))

    def upto(arr, k):  # sum of the first k lengths
        return F.aggregate(F.slice(arr, 1, k), F.lit(0), lambda a, b: a + b)

    def span(k):  # k is the 1-based match number
        start = upto(plen, k) + F.when(k > 1, upto(mlen, k - 1)).otherwise(F.lit(0))
        end = start + F.element_at(mlen, k)
        s = F.greatest(start - chars, F.lit(0))
        e = F.least(end + chars, F.length(text))
        return py_strip(F.substring(text, s + 1, e - s))

    ks = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: n > 0)
    return F.array_distinct(F.transform(ks, span))
