"""HTML as text blocks, with native expressions only.
No DOM: a page becomes an ordered array of block pieces.

A marker is put before every block-level tag (opening or closing), and the
page is split on it.  A piece that starts with ``<p`` or ``<h1..6`` is a
paragraph / heading block whose content runs up to the next block tag - the
same place where an HTML parser closes an unclosed ``<p>``.  Text of a block
is its text nodes (split on tags), entity-decoded, stripped, empties
dropped, joined by one blank (paragraphs) or by nothing (heading titles,
like ``get_text(strip=True)``).  Elements that may hold others of their kind
(junk tables, lists and divisions, infoboxes) are matched with their closing
tags in ``operators/sections.py``.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col, py_strip

BLOCK_MARK = "\u0001"

_CLS = r'''class=["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["']'''


def _inline(tag: str, name: str) -> str:
    """An inline element of a class, with elements of its kind inside."""
    free = rf"(?:(?!</?{tag}\b).)*"
    return rf"<{tag}\b[^>]*" + _CLS.format(name=name) + rf"[^>]*>{free}(?:<{tag}\b[^>]*>{free}</{tag}>{free})*</{tag}>"


# Junk within text (H19): style, script, comments, reference superscripts, back-links.
INLINE_JUNK = "(?is)" + "|".join([
    r"<style\b[^>]*>.*?</style>",
    r"<script\b[^>]*>.*?</script>",
    r"<!--.*?-->",
    _inline("sup", "reference"),
    _inline("span", "mw-cite-backlink"),
])
# Opening tags of junk elements (H19): navbox tables, reference lists, hatnotes, toc.
JUNK_OPEN = "(?is)^(?:" + "|".join([
    r"<table\b[^>]*" + _CLS.format(name="navbox"),
    r"<ol\b[^>]*" + _CLS.format(name="references"),
    r"<div\b[^>]*" + _CLS.format(name="(?:reflist|hatnote)"),
    r'''<div\b[^>]*id=["']toc["']''',
]) + ")"
CONTAINER_OPEN = r"(?is)^<div\b[^>]*" + _CLS.format(name="mw-parser-output")
INFOBOX_OPEN = r"(?is)^<table\b[^>]*" + _CLS.format(name="infobox")
# A page without this has no infobox: the word, or a letter of it before an element that goes.
MAYBE_INFOBOX = r"(?i)infobox|[infob]<(?:style|script|!--|sup|span)"
BLOCK_TAGS = ("h[1-6]|p|div|table|tbody|thead|tfoot|tr|td|th|ul|ol|li|dl|dt|dd|section|article|aside|nav|"
              "header|footer|main|figure|figcaption|blockquote|pre|form|fieldset|address|hr|body|html|head|title")
BLOCK_TAG = rf"(?i)(</?(?:{BLOCK_TAGS})\b[^>]*>)"
# Block tags that are always closed: their pieces carry the nesting depth.
NESTING = ("div", "table", "ul", "ol", "dl", "section", "article", "aside", "nav", "header", "footer", "main", "figure",
           "blockquote", "form", "fieldset", "body", "html")
HTML_TAG = r"<[a-zA-Z][^>]*>"  # B15

ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
# What a browser shows for the numeric forms 128 to 159 (0 where it shows the character itself).
LATIN_CODES = (8364, 0, 8218, 402, 8222, 8230, 8224, 8225, 710, 8240, 352, 8249, 338, 0, 381, 0,
               0, 8216, 8217, 8220, 8221, 8226, 8211, 8212, 732, 8482, 353, 8250, 339, 0, 382, 376)


def is_html(c) -> Column:
    """Some ``<letter ...>`` tag occurs."""
    return col(c).rlike(HTML_TAG)


def strip_inline_junk(c) -> Column:
    """H19, elements within text."""
    return F.regexp_replace(col(c), INLINE_JUNK, "")


def entity_names() -> dict[str, str]:
    """Named entities with their characters; names that browsers know without a
    semicolon stand both ways."""
    return {f"&{name}": text for name, text in html.entities.html5.items()}


def _numeric(entity: Column) -> Column:
    """The character of a decimal or hexadecimal form; U+FFFD for what is no
    character."""
    digits = F.regexp_replace(F.regexp_extract(entity, "([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
    code = F.when(F.length(digits) > 8, F.lit(-1).cast("long")).when(
        entity.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
    shown = F.element_at(F.array(*[F.lit(x) for x in LATIN_CODES]), F.greatest(F.least(code - 127, F.lit(32)), F.lit(1)).cast("int"))
    code = F.when(code.between(128, 159) & (shown > 0), shown).otherwise(code)
    bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    code = F.when(bad, F.lit(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape(c) -> Column:
    """Entities decoded once, left to right: ``&amp;lt;`` gives ``&lt;``.
    Unknown names stay."""
    x = col(c)
    names = F.from_json(F.lit(json.dumps(entity_names())), "map<string,string>")  # folded into one literal
    found = F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0))
    parts = F.split(x, ENTITY, -1)

    def shown(e: Column) -> Column:
        return F.when(e.startswith("&#"), _numeric(e)).otherwise(F.coalesce(F.try_element_at(names, e), e))

    decoded = F.array_join(F.zip_with(parts, F.transform(found, shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(x, F.lit("&")), decoded).otherwise(x)


def unescape_stored(c) -> Column:
    """Backslash escapes of stored HTML (``\\n``, ``\\t``, quotes)."""
    x = col(c)
    for esc, ch in ((r"\\n", "\n"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\'", "'")):
        x = F.regexp_replace(x, esc, ch.replace("\\", "\\\\"))
    return x


def node_text(inner, sep: str = " ") -> Column:
    """Text nodes of an HTML fragment: decoded, stripped, non-empty, joined."""
    nodes = F.transform(F.split(col(inner), r"<[^>]*>"), lambda t: py_strip(unescape(t)))
    return F.array_join(F.filter(nodes, lambda t: F.length(t) > 0), sep)


def block_pieces(c) -> Column:
    """Array of pieces, each starting at a block-level tag."""
    marked = F.regexp_replace(col(c), BLOCK_TAG, BLOCK_MARK + "$1")
    return F.split(marked, BLOCK_MARK)


def strip_citations(c) -> Column:
    """Runs of ``[n]`` with inner blanks, and the blanks after them."""
    return F.regexp_replace(col(c), r"(?:\[\s*\d+\s*\]\s*)+", "")


def tidy(c) -> Column:
    """No blank before ``,`` / ``.``; 2+ blanks collapse; trim."""
    x = F.regexp_replace(col(c), r"\s+([,.])", "$1")
    return py_strip(F.regexp_replace(x, r"\s{2,}", " "))
