"""Page sections: nested elements and entities, against written-out rows."""

from quire.operators import sections as SEC
from tests.conftest import rows

NESTED = """<html><body><p>Site text.</p><div class="mw-parser-output"><div class="hatnote"><div>For <div>others</div></div> see</div>
<table class="infobox"><tr><th>Born</th><td>1960</td></tr>
<tr><th>Works<td><table><tr><td>a</td></tr><tr><th>Alma mater<td>Inner &eacute;cole</table> after
<tr><th>Education</th><td>Town <table><tbody><tr><td>BA</td></tr></tbody></table> College; City School</td></tr></table>
<p>Lead &#91;1&#93; text.</p>
<table class='wide navbox'><tr><td><table><tr><td>x</td></tr></table><p>Junk PhD</p></td></tr></table>
<h2>Life</h2><p>One.</p><div class="reflist"><div><div>r1</div></div><p>Junk two</p></div>loose<p>Two.</p>
<ol class="references"><li>r<ol><li>s</li></ol></li></ol><div id="toc"><div>t</div></div>
<div><h3>Inner</h3><p>Three.</p></div></div></div><p>Four.</p></body></html>"""


def page(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, source string")


def test_nested_junk_goes_as_a_whole(spark):
    got = [r.text for r in SEC.html_blocks(page(spark, NESTED)).orderBy("pos").collect()]
    assert got == ["Lead [1] text.", "Life", "One.", "Two.", "Inner", "Three."]
    text = {r.title: r.content for r in SEC.section_text(page(spark, NESTED)).collect()}
    assert text == {"Life": "One. loose Two. Inner Three.", "Inner": "Three."}


def test_infobox_rows_around_and_inside_nested_tables(spark):
    got = rows(SEC.infobox_pairs(page(spark, NESTED)), "row", "key", "value")
    assert got == [(0, "Born", "1960"), (1, "Works", "a Alma mater Inner école after"), (2, "Alma mater", "Inner école"),
                   (3, "Education", "Town BA College; City School")]
    paras = rows(SEC.infobox_paragraphs(page(spark, NESTED)), "pos", "text")
    assert paras == [(0, "Inner école"), (1, "Town BA College"), (2, "City School")]


def test_unmatched_tags(spark):
    pages = page(spark,
                 '<div class="reflist"><div>open</div><p>kept</p>',                       # never closed: no junk
                 '</div></table><div class="hatnote">x</div><p>after stray tags</p>',       # stray closing tags are ignored
                 '<table class="infobox"><tr><th>K</th><td>V</td></tr>',                   # never closed
                 '<table class="infobox"></table><table class="infobox"><tr><th>K</th><td>V</td></tr></table>',
                 '<table class="navbox"><tr><td><table class="infobox"><tr><th>A</th><td>B</td></tr></table></td></tr></table>', "", None)
    assert rows(SEC.html_blocks(pages), "page_id", "text") == [(0, "kept"), (1, "after stray tags")]
    assert rows(SEC.infobox_pairs(pages), "page_id", "key", "value") == [(2, "K", "V")]
