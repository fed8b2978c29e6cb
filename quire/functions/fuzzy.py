"""Fuzzy ratio and key normalisation (H7, H8, H31-H33, I9) as native
expressions.  The ratio is ``200 * LCS / (len1 + len2)`` (100 for two empty
strings).  LCS is computed bit-parallel: a row of the dynamic programme is the
set bits of a BIGINT (62 characters of the second string each), and a character
of the first string advances the whole row by one addition; longer strings carry
from block to block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col

# Description of a disambiguation page in the search results, its
# label, and the text for a page without a description.
DISAMBIGUATION = "Topics referred to by the same term"
MULTIPLE = "Multiple matches"
NO_DESCRIPTION = "a Wikipedia article"


BITS = 62  # of a row in one BIGINT: the sum of two such numbers still fits


def _chars(c: Column) -> Column:
    """The characters of a string; none for the empty one (``sequence(1, 0)``
    would count down)."""
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(1)))).otherwise(
        F.array().cast("array<string>"))


def _mask(block: Column, c: Column) -> Column:
    """Places of ``c`` in a reversed block of characters: the first is the lowest bit."""
    return F.aggregate(block, F.lit(0).cast("long"), lambda m, x: m * 2 + (x == c).cast("long"))


def _ones(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1


def _one_block(s: Column) -> Column:
    """LCS if the second string fits one block."""
    full = _ones(s["n"])
    masks = F.transform(s["a"], lambda c: _mask(F.reverse(s["b"]), c))
    last = F.aggregate(masks, full, lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m)).bitwiseAND(full))
    return s["n"] - F.bit_count(last)


def _blocks(s: Column) -> Column:
    """LCS over blocks: the lowest first, an addition's carry goes to the next."""
    first = F.sequence(F.lit(1), s["n"], F.lit(BITS))
    parts = F.transform(first, lambda i: F.reverse(F.slice(s["b"], i, F.least(F.lit(BITS), s["n"] - i + 1))))
    masks = F.transform(s["a"], lambda c: F.transform(parts, lambda p: _mask(p, c)))
    start = F.transform(parts, lambda p: _ones(F.size(p)))
    none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("row"))

    def advance(row: Column, mask: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            v, u = x["v"], x["v"].bitwiseAND(x["m"])
            total = v + u + acc["carry"]
            return F.struct(F.shiftright(total, BITS).alias("carry"),
                            F.array_append(acc["row"], total.bitwiseOR(v - u).bitwiseAND((1 << BITS) - 1)).alias("row"))
        return F.aggregate(F.arrays_zip(row.alias("v"), mask.alias("m")), none, one, lambda acc: acc["row"])

    last = F.aggregate(masks, start, advance)
    # the last block's bits beyond the string are no part of it
    kept = F.transform(last, lambda v, i: F.bit_count(v.bitwiseAND(_ones(F.least(F.lit(BITS), s["n"] - i * BITS)))))
    return s["n"] - F.aggregate(kept, F.lit(0), lambda t, x: t + x)


def lcs_length(a, b) -> Column:
    a, b = col(a), col(b)
    n = F.length(b)
    # the strings' characters are taken apart once and named in a lambda
    named = F.array(F.struct(_chars(a).alias("a"), _chars(b).alias("b"), n.alias("n")))
    one, more = F.transform(named, _one_block)[0], F.transform(named, _blocks)[0]
    return F.when((F.length(a) == 0) | (n == 0), F.when(a.isNotNull() & b.isNotNull(), 0)).when(n <= BITS, one).otherwise(more)


def ratio(a, b) -> Column:
    """Indel similarity in percent, as the reference's scorer computes it."""
    total = F.length(col(a)) + F.length(col(b))
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / total)


def query_key(c) -> Column:
    """H7: lower case, blanks -> '_', dots removed."""
    return F.replace(F.replace(F.lower(col(c)), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def candidate_key(c, strip_dots: bool = True) -> Column:
    """H7: lower case, blanks -> '_'; dots removed unless ``strip_dots`` is
    False (the live lookup keeps them, Q13)."""
    x = F.replace(F.lower(col(c)), F.lit(" "), F.lit("_"))
    return F.replace(x, F.lit("."), F.lit("")) if strip_dots else x


def key_from_url(c) -> Column:
    """H8: trailing '/' and newlines stripped, last path segment."""
    return F.element_at(F.split(F.regexp_replace(col(c), r"[/\n]+$", ""), "/"), -1)


def page_url(key, prefix: str = "https://en.wikipedia.org/wiki/") -> Column:
    """H31."""
    return F.concat(F.lit(prefix), col(key))


def description_or_default(c) -> Column:
    """A missing description gets a fixed text, that of a disambiguation
    page a label."""
    return F.when(col(c) == DISAMBIGUATION, F.lit(MULTIPLE)).otherwise(F.coalesce(col(c), F.lit(NO_DESCRIPTION)))


def first_name_in_key(name, key) -> Column:
    """The query's first word occurs in the candidate key."""
    return F.lower(col(key)).contains(F.lower(F.split(col(name), r"\s+")[0]))
