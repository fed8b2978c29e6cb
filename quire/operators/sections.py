"""Pages -> blocks -> sections.

A page is exploded into its block pieces; everything after is windows per page,
over one shuffle by page.  Tables, divisions and ordered lists are matched with
their closing tags by nesting level: an opening tag and the tag that closes it
are neighbours among the page's tags of that name and level, whatever is nested
inside.  Junk elements (navboxes, reference lists, hatnotes, tables of contents)
are intervals of pieces between two such tags and go as a whole; the
``mw-parser-output`` container and the infobox are intervals, too.  An opening
tag without a closing one makes junk of nothing, and a closing tag without an
opening one is ignored.

The nesting depth of a piece is a running sum of opening and closing tags
per page, so a section ends where the element that holds its heading closes.
Attributing paragraphs to headings is a window per page ordered by block
position: the nearest preceding heading of any level (E1); paragraphs before
the first heading are the lead (E8), which only exists inside the
``mw-parser-output`` container (Q18).  A page's blocks are bounded by the
size of that one page, so per-page windows and groups never gather an
unbounded set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H

# Section titles skipped (the shipped blacklist, trimmed).
BLACKLIST = ("See also", "References", "External links", "Further reading", "Notes")
# Heading keywords in list order (the shipped keyword list).
KEYWORDS = ("education", "early life", "biography", "career", "Academic", "Personal life", "Background",
            "Early years", "young", "Journalism", "Early life", "Early and personal life", "Biography",
            "References", "Career")
LEAD = "_lead_"
INFOBOX_TITLE = "_infobox_education_"
INFOBOX_RANK = 1 << 40  # the infobox pseudo-section comes after every heading


def _tagged(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Every piece of a page outside junk: (page_id, pos, piece, name, turn,
    close, container, infobox).  ``name`` is the piece's tag, ``turn`` +1 / -1 /
    0 where it opens, closes or is none; the tag that closes a junk element is
    none.  ``close`` is the place of the tag that closes a table, division or
    ordered list; ``container`` and ``infobox`` mark their opening tags."""
    clean = pages.select(F.col(id_col).alias("page_id"), H.block_pieces(H.strip_inline_junk(F.col(html_col))).alias("_pieces"))
    # _outer: a plain explode makes the optimizer re-run the regex pipeline in an
    # inferred size() filter; the filter below drops the null row instead
    p = clean.select("page_id", F.posexplode_outer("_pieces").alias("pos", "piece")).where(F.col("piece").isNotNull())
    p = p.select("page_id", F.col("pos").cast("long").alias("pos"), "piece",
                 F.lower(F.regexp_extract("piece", "^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("name")).repartition("page_id")
    opens = F.when(F.col("name") == "", 0).when(F.col("piece").startswith("</"), -1).otherwise(1)
    p = p.withColumn("turn", opens)
    own = F.when(F.col("name").isin("table", "div", "ol"), F.col("turn")).otherwise(0)
    so_far = Window.partitionBy("page_id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_sum", F.sum(own).over(so_far)).withColumn("_low", F.least(F.min("_sum").over(so_far), F.lit(0)))
    # closing tags without an opening one do not lower the level
    p = p.withColumn("_level", F.col("_sum") - F.col("_low") + F.when(own < 0, 1).otherwise(0))
    at = Window.partitionBy("page_id", "name", "_level").orderBy("pos")
    p = p.withColumn("close", F.when((own > 0) & (F.lead("turn").over(at) < 0), F.lead("pos").over(at)))
    p = p.withColumn("_junk", F.col("close").isNotNull() & F.col("piece").rlike(H.JUNK_OPEN))
    p = p.withColumn("_end", F.coalesce((own < 0) & F.lag("_junk").over(at), F.lit(False)))
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_junk"), 1).when(F.col("_end"), -1).otherwise(0)
    p = p.withColumn("_inside", F.sum(step).over(page)).where("_inside = 0")
    return p.select("page_id", "pos", "piece", F.when(F.col("_end"), F.lit("")).otherwise(F.col("name")).alias("name"),
                    F.when(F.col("_end"), 0).otherwise(F.col("turn")).alias("turn"), "close",
                    ((F.col("name") == "div") & F.col("piece").rlike(H.CONTAINER_OPEN)).alias("container"),
                    ((F.col("name") == "table") & F.col("piece").rlike(H.INFOBOX_OPEN)).alias("infobox"))


def _within(tagged: DataFrame, mark: str) -> DataFrame:
    """Adds ``first`` (place, close) of the page's first piece with a mark."""
    page = Window.partitionBy("page_id")
    return tagged.withColumn("first", F.min(F.when(F.col(mark), F.struct("pos", F.coalesce("close", F.lit(1 << 40).cast("long"))
                                                                         .alias("close")))).over(page))


def _text(sep: str = " "):
    return H.node_text(F.regexp_replace("piece", r"^<[^>]*>", ""), sep)


def _pieces(pages: DataFrame, id_col: str, html_col: str, loose: bool) -> DataFrame:
    """Every piece of the page's container, or of the page if it has none:
    (page_id, pos, kind 'p'|'h'|'o', level, text, container, step).  ``step`` is
    +1 / -1 where a nesting tag opens / closes.  Kind 'o' is all else (list items,
    cells, loose text); its text is null unless ``loose``."""
    t = _within(_tagged(pages, id_col, html_col), "container")
    inside = F.col("first").isNotNull()
    t = t.where(~inside | ((F.col("pos") >= F.col("first.pos")) & (F.col("pos") < F.col("first.close"))))
    is_h = (F.col("turn") > 0) & F.col("name").rlike("^h[1-6]$")
    is_p = (F.col("turn") > 0) & (F.col("name") == "p")
    own = inside & (F.col("pos") == F.col("first.pos"))  # the container itself
    return t.select(
        "page_id", "pos", F.when(is_h, F.lit("h")).when(is_p, F.lit("p")).otherwise(F.lit("o")).alias("kind"),
        F.when(is_h, F.substring("name", 2, 1).cast("int")).alias("level"),
        F.when(is_h, _text("")).otherwise(_text() if loose else F.when(is_p, _text())).alias("text"),
        inside.alias("container"),
        F.when(F.col("name").isin(*H.NESTING) & ~own, F.col("turn")).otherwise(F.lit(0)).alias("step"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "source") -> DataFrame:
    """(page_id, pos, kind 'p'|'h', level, text, container) per block."""
    return _pieces(pages, id_col, html_col, False).where(F.col("kind") != "o").drop("step")


def _nested(pieces: DataFrame) -> DataFrame:
    """Adds ``depth``: open nesting tags at the piece."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pieces.withColumn("depth", F.sum("step").over(w)).drop("step")


def _attributed(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_h = F.col("kind") == "h"
    return blocks.select(
        "*",
        F.last(F.when(is_h, F.col("pos")), ignorenulls=True).over(w).alias("head_pos"),
        F.last(F.when(is_h, F.col("text")), ignorenulls=True).over(w).alias("head_title"))


ROW_ENDS = ("tr", "tbody", "thead", "tfoot")
CELLS = ("th", "td")


def infobox_pairs(pages: DataFrame, id_col: str = "page_id", html_col: str = "source") -> DataFrame:
    """(page_id, row, key, value) of the first infobox: its rows, those of
    nested tables among them, that hold a header and a data cell, with the whole
    text of the first of each.  A row ends at the next row of its own table, a
    cell at the next cell or row of its own table, and both where that table
    ends."""
    t = _within(_tagged(pages.where(F.col(html_col).rlike(H.MAYBE_INFOBOX)), id_col, html_col), "infobox")
    t = t.where((F.col("pos") >= F.col("first.pos")) & (F.col("pos") <= F.col("first.close")))
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_table = F.col("name") == "table"
    t = t.withColumn("_depth", F.sum(F.when(is_table, F.col("turn")).otherwise(0)).over(page))
    t = t.withColumn("table", F.col("_depth") + F.when(is_table & (F.col("turn") < 0), 1).otherwise(0))
    later = Window.partitionBy("page_id", "table").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    row_end = F.col("name").isin(*ROW_ENDS) | (is_table & (F.col("turn") < 0))
    far = F.lit(1 << 40).cast("long")
    t = t.select("page_id", "pos", "name", "turn", _text().alias("text"),
                 F.coalesce(F.min(F.when(row_end, F.col("pos"))).over(later), far).alias("row_end"),
                 F.coalesce(F.min(F.when(row_end | F.col("name").isin(*CELLS), F.col("pos"))).over(later), far).alias("cell_end"))
    opens = t.where("turn > 0")
    rows = opens.where("name = 'tr'").select("page_id", F.col("pos").alias("r"), "row_end")
    cells = opens.where(F.col("name").isin(*CELLS)).select(F.col("page_id").alias("c_page"), F.col("pos").alias("c"), "name", "cell_end")
    body = t.select(F.col("page_id").alias("t_page"), "pos", "text")
    # ranges inside one page: equi joins on it
    cell_text = (cells.join(body, (F.col("c_page") == F.col("t_page")) & (F.col("pos") >= F.col("c")) & (F.col("pos") < F.col("cell_end")))
                 .groupBy("c_page", "c", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t")))
    shown = F.array_join(F.filter(F.transform("_t", lambda x: x["text"]), lambda x: x != ""), " ")
    cell_text = cell_text.select("c_page", "c", "name", shown.alias("text"))
    both = rows.join(cell_text, (F.col("page_id") == F.col("c_page")) & (F.col("c") > F.col("r")) & (F.col("c") < F.col("row_end")))
    first = {k: F.min_by(F.when(F.col("name") == k, F.col("text")), F.when(F.col("name") == k, F.col("c"))) for k in CELLS}
    pairs = (both.groupBy("page_id", "r").agg(first["th"].alias("key"), first["td"].alias("value"))
             .where("key IS NOT NULL AND value IS NOT NULL"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("r")) - 1
    return pairs.select("page_id", n.cast("long").alias("row"), "key", "value")


def infobox_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "source") -> DataFrame:
    """Education rows of the first infobox, values joined by '; '
    then split on '; ' into pseudo-paragraphs."""
    key = F.lower("key")
    edu = infobox_pairs(pages, id_col, html_col).where(key.contains("education") | key.contains("alma mater"))
    edu = edu.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("r"))
    joined = F.array_join(F.transform("r", lambda x: x["value"]), "; ")
    paras = edu.select("page_id", F.posexplode_outer(F.split(joined, "; ", -1)).alias("pos", "text")) \
              .where(F.col("text").isNotNull())
    return paras.select("page_id", F.lit(INFOBOX_TITLE).alias("title"), F.lit(INFOBOX_RANK).cast("long").alias("sec_rank"),
                        F.col("pos").cast("long").alias("pos"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def html_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "source",
                  blacklist: Sequence[str] | DataFrame = BLACKLIST) -> DataFrame:
    """(page_id, title, sec_rank, pos, text) for every paragraph of the
    lead, of each non-blacklisted heading section, and of the infobox.
    ``sec_rank`` orders sections (lead -1, headings by position, infobox last)."""
    a = _attributed(_nested(_pieces(pages, id_col, html_col, False))).where(F.col("kind") == "p")
    a = a.where(F.col("head_pos").isNotNull() | F.col("container"))
    paras = a.select("page_id", F.coalesce("head_title", F.lit(LEAD)).alias("title"),
                     F.coalesce("head_pos", F.lit(-1).cast("long")).alias("sec_rank"), "pos", "text")
    if isinstance(blacklist, DataFrame):  # B16 as an anti join with a term table
        terms = blacklist.select(F.col("term").alias("title")).distinct()
        paras = paras.join(terms, "title", "left_anti")
    else:
        paras = paras.where(~F.col("title").isin(list(blacklist)) | (F.col("sec_rank") < 0))
    return paras.unionByName(infobox_paragraphs(pages, id_col, html_col))


def heading_tree(pages: DataFrame, id_col: str = "page_id", html_col: str = "source") -> DataFrame:
    """(page_id, pos, level, title, parent_pos) with parent = nearest
    previous heading of a strictly lower level."""
    h = html_blocks(pages, id_col, html_col).where(F.col("kind") == "h")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(w) for k in range(1, 6)}
    cands = [F.when(F.col("level") > k, last[k]) for k in range(1, 6)]
    return h.select("page_id", "pos", "level", F.col("text").alias("title"),
                    F.greatest(*cands).alias("parent_pos"))


def section_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "source") -> DataFrame:
    """(page_id, pos, level, title, content): all text after a heading
    (paragraphs, list items, table cells, loose text, nested subsections) up
    to the next heading of the same or a higher level or the end of the
    element that holds the heading.  The range join is an equi join on the
    page key plus a position range, so it stays inside one page."""
    b = _nested(_pieces(pages, id_col, html_col, True))
    h = b.where(F.col("kind") == "h")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    nxt = {k: F.min(F.when(F.col("level") == k, F.col("pos"))).over(w) for k in range(1, 7)}
    ends = [F.when(F.col("level") >= k, nxt[k]) for k in range(1, 7)]
    heads = h.select("page_id", F.col("pos").alias("h_pos"), "level", "depth", F.col("text").alias("title"),
                     F.coalesce(F.least(*ends), F.lit(1 << 40).cast("long")).alias("h_end"))
    body = b.select(F.col("page_id").alias("b_page"), F.col("pos").alias("b_pos"), F.col("text").alias("b_text"),
                    F.col("kind").alias("b_kind"), F.col("depth").alias("b_depth"))
    inside = heads.join(body, (F.col("page_id") == F.col("b_page")) & (F.col("b_pos") > F.col("h_pos"))
                        & (F.col("b_pos") < F.col("h_end")), "left")
    grouped = inside.groupBy("page_id", "h_pos", "level", "title", "depth").agg(
        F.min(F.when(F.col("b_depth") < F.col("depth"), F.col("b_pos"))).alias("_end"),
        F.array_sort(F.collect_list(F.when((F.col("b_kind") != "o") | (F.col("b_text") != ""),
                                           F.struct("b_pos", "b_text")))).alias("_t"))
    kept = F.filter("_t", lambda x: F.col("_end").isNull() | (x["b_pos"] < F.col("_end")))
    content = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["b_text"]), " "), r"^\s+|\s+$", "")
    return grouped.select("page_id", F.col("h_pos").alias("pos"), "level", "title", content.alias("content"))


def keyword_of(title_col: str, keywords: Sequence[str] = KEYWORDS):
    """First keyword (list order) contained in the title, case-sensitive."""
    expr = F.lit(None).cast("string")
    for kw in reversed(list(keywords)):
        expr = F.when(F.col(title_col).contains(kw), F.lit(kw)).otherwise(expr)
    return expr


def title_keywords(pages: DataFrame, id_col: str = "page_id", html_col: str = "source") -> DataFrame:
    """Headings whose title holds a keyword, with the first keyword."""
    h = html_blocks(pages, id_col, html_col).where(F.col("kind") == "h")
    k = h.select("page_id", "pos", "level", F.col("text").alias("title"), keyword_of("text").alias("keyword"))
    return k.where(F.col("keyword").isNotNull())
