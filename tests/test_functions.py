"""Golden micro-cases for the Column functions, including the quirks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import degrees as D
from quire.functions import html as H
from quire.functions.fuzzy import key_from_url, query_key, ratio
from quire.functions.lists import list_items, parse_argument, response_content
from quire.functions.names import fix_caps, is_valid_author, needs_entity_model, uninvert_name
from quire.functions.text import py_isupper
from quire.operators.arguments import render_prompt
from quire.operators.dedup import embedding_set, float16, shingle_sets


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("byline,gated", [
    ("John Smith", False),
    ("Kirby Jones", True),          # 'by' is a substring keyword (Q1)
    ("Guest Writer", False),         # 'guest' is lost in the merged keyword (Q1)
    ("Ann Lee; Bo Kim", True),       # ';' gates the split branch itself (Q2)
    ("JOHN SMITH", True),            # all caps
    ("Al B", True),                  # shorter than 5 characters
    ("a b c d e f g", True),         # more than 6 tokens
    ("Jo Doe #3", True),             # symbol
    (None, False),
])
def test_entity_gate(spark, byline, gated):
    assert one(spark, needs_entity_model, byline) is gated


def test_entity_gate_fixed_keywords(spark):
    assert one(spark, lambda c: needs_entity_model(c, fix_keywords=True), "Guest Writer") is True


@pytest.mark.parametrize("value,expected", [
    ("JOHN SMITH", "John Smith"), ("McDONALD ann", "McDONALD ann"), ("JOHN 3", "John 3"),
    ("  ANA  DE  LA ", "Ana De La"),
])
def test_fix_caps(spark, value, expected):
    assert one(spark, fix_caps, value) == expected


def test_isupper_matches_python(spark):
    samples = ["JOHN 3", "John", "123", "ÉCOLE", "ǅ", "", "A-B"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = {r.v: r.u for r in df.select("v", py_isupper("v").alias("u")).collect()}
    assert got == {s: s.isupper() for s in samples}


@pytest.mark.parametrize("value,expected", [
    ("Smith, John", "John Smith"),
    ("Smith, John; Michael", "John Smith Michael"),    # rest goes last (Q9)
    ("Smith, John; Jr", "John Smith Jr"),
    ("Smith., John;", "John Smith"),
    ("Doe, Jane, Extra", "Jane Doe Extra"),
    ("Plain Name", "Plain Name"),
    ("Spaced   Name", "Spaced Name"),
])
def test_uninvert(spark, value, expected):
    assert one(spark, uninvert_name, value) == expected


@pytest.mark.parametrize("value,ok", [
    ("John Smith", True), ("John", False), ("JOHN SMITH", False), ("Ann | Bo", False),
    ("The House Team", False), ("Board Member", False), (None, False),
])
def test_valid_author(spark, value, ok):
    assert one(spark, is_valid_author, value) is ok


def py_list_items(text, mode="reference"):
    out = []
    for raw in text.split("\n"):
        line = raw.strip()
        if not line or not (line[0].isdigit() or line.startswith("-")):
            continue
        if mode == "reference":
            item = line.split(".", 1)[-1].strip() if "." in line else line
            item = item.lstrip("- ").strip()
        else:
            item = re.sub(r"^(\d+[.)](\s+|$)|-+\s*)", "", line).strip()
        if item:
            out.append(item)
    return out


LIST_CASES = [
    "Intro\n1. The U.S. economy\n- Ends with a period.\n2020 was bad\n-  dash item\n\n3) paren",
    "1.5 million\n12) twelve\n3.",
    "- a\n-\n  7. seven  \nnot a marker\n- x.y.z",
    "",
]


@pytest.mark.parametrize("text", LIST_CASES)
@pytest.mark.parametrize("mode", ["reference", "marker"])
def test_list_items(spark, text, mode):
    assert one(spark, lambda c: list_items(c, mode), text) == py_list_items(text, mode)


def test_list_items_reference_quirk(spark):
    got = one(spark, list_items, "- The U.S. economy\n- Ends with a period.\n2020 was bad")
    assert got == ["S. economy", "2020 was bad"]  # Q6


def py_argument(text):
    claim, prem, sec = "", [], None
    for raw in text.split("\n"):
        line = raw.strip()
        if line.startswith("Claim:"):
            claim, sec = line.split(":", 1)[-1].strip(), "claim"
        elif line.startswith("Premises:"):
            sec = "premises"
        elif sec == "premises" and line:
            items = py_list_items(line)
            prem += items
    return claim, prem


@pytest.mark.parametrize("text", [
    "Claim: a\nPremises: ignored\n1. first\n- second\nClaim: b\n- lost",
    "Premises:\n- early\nClaim: late\n2. lost",
    "no structure",
    "Claim: x: y\nPremises:\n1. p\n\n2. q",
])
def test_parse_argument(spark, text):
    r = one(spark, parse_argument, text)
    assert (r["claim"], list(r["premises"])) == py_argument(text)


def test_response_content(spark):
    df = spark.createDataFrame(
        [('{"response": {"body": {"choices": [{"message": {"content": "  hi  "}}]}}}',),
         ('{"response": {"body": {}}}',), ('{"response": {"body": {"choices": []}}}',), ("not json",), (None,)],
        "v string")
    from quire.sources.readers import RESPONSE_SCHEMA
    got = [r.o for r in df.select(response_content(F.from_json("v", RESPONSE_SCHEMA)["response"]).alias("o")).collect()]
    assert got == ["hi", "", "", "", ""]


def test_prompt_slots_filled_once(spark):
    df = spark.createDataFrame([("see {conclusion} here",)], "text string")
    got = df.select(render_prompt("T: {text} / C: {conclusion} {{lit}}", text=F.col("text"),
                                  conclusion=F.lit("X")).alias("p")).first().p
    assert got == "T: see {conclusion} here / C: X {lit}"


def test_float16_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 0.1, 400), rng.normal(0, 1e-5, 50), [0.0, 2.0, -8.0, 0.5, 65504.0, 1e-8],
                           rng.uniform(-100, 100, 50)]).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in vals], "v float")
    got = [r.h for r in df.select(float16("v").alias("h")).collect()]
    want = [float(np.float16(v)) for v in vals]
    assert got == want


def test_embedding_set_ignores_order_and_repeats(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.1],), ([0.2, 0.1],)], "e array<float>")
    a, b = [r.s for r in df.select(embedding_set("e").alias("s")).collect()]
    assert a == b and len(a) == 2


def test_shingles(spark):
    df = spark.createDataFrame([(1, "A b c d"), (2, "one two"), (3, "   ")], "id long, t string")
    got = {r.id: r.tokens for r in shingle_sets(df, "id", "t", 3, hashed=False).collect()}
    assert got == {1: ["a b c", "b c d"], 2: ["one two"], 3: []}
    hashed = {r.id: r.tokens for r in shingle_sets(df, "id", "t", 3).collect()}
    assert {k: len(v) for k, v in hashed.items()} == {1: 2, 2: 1, 3: 0}


def py_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = m[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(m[i - 1][j], m[i][j - 1])
    return m[-1][-1]


def test_ratio_matches_lcs_definition(spark):
    pairs = [("john_smith", "john_smith"), ("john_smith", "jon_smyth"), ("", ""), ("abc", ""), ("kitten", "sitting"),
             ("joseph_r_biden_jr", "joe_biden"), ("ábc", "abc"), ("😀a😀", "a😀b")]
    rng = np.random.default_rng(2)  # around the block bounds, and names of 200 characters
    pairs += [tuple("".join(rng.choice(list("abcé_"), n)) for n in (m, k))
              for m, k in ((61, 62), (62, 61), (63, 62), (62, 63), (5, 64), (64, 5), (124, 125), (125, 124), (200, 200), (200, 7), (7, 200))]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.r for r in df.select(ratio("a", "b").alias("r")).collect()]
    want = [100.0 if not (a or b) else 200.0 * py_lcs(a, b) / (len(a) + len(b)) for a, b in pairs]
    assert got == pytest.approx(want)


def test_keys(spark):
    df = spark.createDataFrame([("J. R. Smith", "https://x.org/wiki/J._R._Smith/\n")], "n string, u string")
    r = df.select(query_key("n").alias("q"), key_from_url("u").alias("k")).first()
    assert (r.q, r.k) == ("j_r_smith", "J._R._Smith")


def test_patterns_agree_with_python_on_ascii(spark):
    strict = re.compile(D.STRICT[4:], re.IGNORECASE)
    loose = re.compile(D.LOOSE[4:], re.IGNORECASE)
    samples = ["He earned a B.A. in 1980.", "She holds a Ph.D.", "MAthematics", "many ways", "the MS degree",
               "graduated late", "Bachelor's", "masters", "LLMs", "JD", "nothing here", "Abba"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = {r.t: (r.s, r.l) for r in df.select("t", D.mentions("t").alias("s"), D.mentions("t", "loose").alias("l")).collect()}
    assert got == {s: (bool(strict.search(s)), bool(loose.search(s))) for s in samples}


def test_word_boundary_is_unicode_like_python(spark):
    # 'éMA' has no boundary before M for Python's \b: no strict hit
    df = spark.createDataFrame([("éMA x",), ("é MA x",)], "t string")
    got = [r.s for r in df.select(D.mentions("t").alias("s")).collect()]
    assert got == [bool(re.search(D.STRICT[4:], "éMA x", re.I)), True]


def test_sentences(spark):
    txt = "He earned a B.A. in 1980. He then moved. Dr. Smith came! Then J. K. Rowling wrote. 3 cats."
    got = one(spark, D.sentences, txt)
    assert got == ["He earned a B.A. in 1980.", "He then moved.", "Dr. Smith came!",
                   "Then J. K. Rowling wrote.", "3 cats."]


def test_html_blocks_text(spark):
    frag = '<p>Kim &amp; Doe <b>holds</b>, a <a href="x">Ph.D.</a></p>'
    got = one(spark, lambda c: H.node_text(F.regexp_replace(c, r"^<[^>]*>", ""), " "), frag)
    assert got == "Kim & Doe holds , a Ph.D."


def test_strip_junk_and_is_html(spark):
    page = '<html><script>var t="</p>";</script><!-- c --><style>p{}</style><p>ok</p></html>'
    assert one(spark, H.strip_inline_junk, page) == "<html><p>ok</p></html>"
    refs = 'a<sup class="reference">[<sup>1</sup>]</sup>b<sup>c</sup><span class="mw-cite-backlink"><span>^</span></span>d'
    assert one(spark, H.strip_inline_junk, refs) == "ab<sup>c</sup>d"
    assert one(spark, H.is_html, "plain text") is False
    assert one(spark, H.is_html, "a <b>bold</b>") is True


@pytest.mark.parametrize("text,want", [
    ("caf&eacute; &#91;1&#93; &#x5B;2&#X5d;", "café [1] [2]"), ("&amp;lt; &lt;b&gt; &amp;amp;", "&lt; <b> &amp;"),
    ("&#128512; &#0; &#xD800; &#x110000; &#99999999999;", "😀 \ufffd \ufffd \ufffd \ufffd"),
    ("&#150; &#x80; &#129;", "– € \x81"), ("&nosuch; & &; &#; &#x; a&b", "&nosuch; & &; &#; &#x; a&b"),
    ("&nbsp;&copy 2020 &NotEqualTilde; &hellip;", "\xa0© 2020 \u2242\u0338 …"), ("none", "none"), (None, None)])
def test_entities(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(H.unescape("t").alias("s")).first().s == want
    if text and "[" in want:
        assert one(spark, lambda c: H.strip_citations(H.unescape(c)), text) == "café "


def test_char_spans(spark):
    text = "x" * 150 + " holds a PhD and an MA " + "y" * 150
    got = one(spark, lambda c: D.char_spans(c, 20), text)
    want = []
    for m in re.finditer(D.STRICT[4:], text, re.I):
        s = text[max(0, m.start() - 20): min(len(text), m.end() + 20)].strip()
        if s not in want:
            want.append(s)
    assert got == want


def test_hashed_shingles_keep_jaccard(spark):
    import itertools
    import random
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30))) for _ in range(25)] + ["one", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    s = {r.id: set(r.tokens) for r in shingle_sets(df, "id", "t", 3, hashed=False).collect()}
    h = {r.id: set(r.tokens) for r in shingle_sets(df, "id", "t", 3).collect()}
    for a, b in itertools.combinations(sorted(s), 2):
        assert len(s[a] & s[b]) == len(h[a] & h[b]) and len(s[a]) == len(h[a])


def test_section_text_keeps_lists_tables_and_loose_text_inside_the_container(spark):
    from quire.operators import sections as SEC
    html = ("<div class='mw-parser-output'><p>Lead.</p><h2>Education</h2><p>Intro.</p><ul><li>BA, Yale</li><li>JD</li></ul>"
            "Loose.<table><tr><td>1990</td></tr></table><h3>Sub</h3><p>In.</p><h2>Next</h2><p>Other.</p></div>"
            "<p>Footer graduated</p>")
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<h2>A</h2>open <section><h2>B</h2><ol><li>x</li></ol></section>tail")],
                                  "page_id long, source string")
    got = {(r.page_id, r.title): r.content for r in SEC.section_text(pages).collect()}
    assert got == {(1, "Education"): "Intro. BA, Yale JD Loose. 1990 Sub In.", (1, "Sub"): "In.", (1, "Next"): "Other.",
                   (3, "A"): "open", (3, "B"): "x"}
    paras = sorted((r.title, r.text) for r in SEC.html_sections(pages).collect())
    assert paras == [("Education", "Intro."), ("Next", "Other."), ("Sub", "In."), ("_lead_", "Lead.")]
