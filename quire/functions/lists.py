"""Completion-text parsers as native array expressions.

They run per row inside the executor (higher-order functions over the
lines of one text); no shuffle and no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col, lstrip_chars, py_strip

MARKER = r"^(\p{Nd}|-)"  # B26: a trimmed line starting with a digit or '-'


def has_list_marker(c) -> Column:
    """B26 on one (already trimmed) line."""
    return col(c).rlike(MARKER)


def _item(line: Column, mode: str) -> Column:
    """Text of one marker line.

    ``reference`` (Q6): text after the first '.', if any, then leading '-' and
    blanks removed - so ``- The U.S. economy`` gives ``S. economy``.
    ``marker``: only a leading ``12.`` or ``12)`` before a blank, or ``-``, is
    removed (``2020 was bad`` and ``1.5 million`` stay)."""
    if mode == "reference":
        after = F.when(F.instr(line, ".") > 0, F.substring(line, F.instr(line, ".") + 1, 1 << 30)).otherwise(line)
        return py_strip(lstrip_chars(py_strip(after), "- "))
    if mode == "marker":
        return py_strip(F.regexp_replace(line, r"^(\p{Nd}+[.)](\s+|$)|-+\s*)", ""))
    raise ValueError(f"unknown list mode {mode}")


def list_items(c, mode: str = "reference", limit: int | None = None) -> Column:
    """Items of the numbered / bulleted lines of a text, in order;
    ``limit`` keeps the first n (F1: the Socratic question cap is 10)."""
    lines = F.transform(F.split(col(c), "\n"), lambda l: py_strip(l))
    marked = F.filter(lines, lambda l: (F.length(l) > 0) & has_list_marker(l))
    items = F.filter(F.transform(marked, lambda l: _item(l, mode)), lambda t: F.length(t) > 0)
    if limit is not None:
        items = F.slice(items, 1, limit)
    return F.coalesce(items, F.array().cast("array<string>"))


def parse_argument(c, mode: str = "reference") -> Column:
    """struct(claim, premises) from a Claim / Premises block.

    The last ``Claim:`` line wins; premise lines count only while inside a
    ``Premises:`` section, which a later ``Claim:`` ends; text on the
    ``Premises:`` line itself is ignored.  Absent parts give '' and []."""
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda l: py_strip(l))
    init = F.struct(F.lit("").alias("claim"), F.lit("").alias("section"),
                    F.array().cast("array<string>").alias("premises"))

    def step(acc, line):
        item = _item(line, mode)
        is_claim = line.startswith("Claim:")
        is_prem = line.startswith("Premises:")
        take = ((acc["section"] == "premises") & (F.length(line) > 0) & has_list_marker(line)
                & (F.length(item) > 0))
        claim_text = py_strip(F.substring(line, F.instr(line, ":") + 1, 1 << 30))
        return (F.when(is_claim, F.struct(claim_text.alias("claim"), F.lit("claim").alias("section"),
                                          acc["premises"].alias("premises")))
                 .when(is_prem, F.struct(acc["claim"].alias("claim"), F.lit("premises").alias("section"),
                                         acc["premises"].alias("premises")))
                 .when(take, F.struct(acc["claim"].alias("claim"), acc["section"].alias("section"),
                                      F.array_append(acc["premises"], item).alias("premises")))
                 .otherwise(acc))

    out = F.aggregate(lines, init, step)
    return F.struct(out["claim"].alias("claim"), out["premises"].alias("premises"))


def response_content(response) -> Column:
    """First choice's message content, trimmed; '' when any level is
    missing or null (``response`` is the parsed ``response`` struct)."""
    r = col(response)
    content = F.get(r["body"]["choices"], 0)["message"]["content"]
    return F.coalesce(py_strip(content), F.lit(""))
