"""Only pages that may hold an infobox are taken apart for one."""

from quire.operators import sections as SE


def test_pages_without_an_infobox_are_not_parsed_for_it(spark, monkeypatch):
    row = "<tr><th>Education</th><td>School {}</td></tr></table>"
    pages = [(1, '<table class="infobox vcard">' + row.format(1)), (2, '<TABLE CLASS="InfoBox">' + row.format(2)),
             (3, '<p>a</p><table class="info<!-- x -->box">' + row.format(3)), (4, '<table class="plain">' + row.format(4)),
             (5, "<p>No table, a list.</p><ul><li>one</li></ul>"), (6, None)]
    df = spark.createDataFrame(pages, "page_id long, source string")
    parsed, keep = [], SE._tagged
    monkeypatch.setattr(SE, "_tagged", lambda p, *a: parsed.extend(r.page_id for r in p.collect()) or keep(p, *a))
    got = sorted((r.page_id, r.value) for r in SE.infobox_pairs(df).collect())
    assert sorted(parsed) == [1, 2, 3]  # all of them before
    assert got == [(1, "School 1"), (2, "School 2"), (3, "School 3")]
