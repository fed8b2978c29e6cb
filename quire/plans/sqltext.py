"""DuckDB SQL fragments for the oracle texts (independent of the Spark code:
these only build SQL strings for the second engine)."""

from __future__ import annotations

from quire.functions.names import GATE_KEYWORDS, GATE_SYMBOLS, JUNK_TERMS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def isupper(x: str) -> str:
    return f"(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def ntok(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(string_split_regex({s}, '\\s+')) END)"


def gate(x: str) -> str:
    hits = " OR ".join(f"contains(lower({x}), {q(k)})" for k in GATE_KEYWORDS)
    syms = " OR ".join(f"contains({x}, {q(s)})" for s in GATE_SYMBOLS)
    return (f"coalesce(({hits}) OR {isupper(x)} OR length({strip(x)}) < 5 OR {ntok(x)} > 6 OR ({syms}), false)")


def capitalize(t: str) -> str:
    return f"(upper(substring({t}, 1, 1)) || lower(substring({t}, 2)))"


def fixcaps(x: str) -> str:
    return (f"array_to_string(list_transform(string_split_regex({strip(x)}, '\\s+'), "
            f"lambda t: CASE WHEN {isupper('t')} THEN {capitalize('t')} ELSE t END), ' ')")


def uninvert(x: str, collapse: bool = True) -> str:
    p0 = f"string_split({x}, ', ')[1]"
    p1 = f"string_split({x}, ', ')[2]"
    p2 = f"string_split({x}, ', ')[3]"
    first = strip(f"split_part({p1}, ';', 1)")
    rest1 = f"(CASE WHEN contains({p1}, ';') THEN substring({p1}, instr({p1}, ';') + 1) END)"
    rest = f"trim(coalesce({strip(rest1)}, '') || '; ' || coalesce({p2}, ''), '; ')"
    name = (f"(CASE WHEN {p1} IS NULL THEN {p0} ELSE trim({first}, '.;') || ' ' || trim({p0}, ';. ') "
            f"|| ' ' || trim({rest}, ';.') END)")
    if collapse:
        return strip(f"regexp_replace({name}, '\\s+', ' ', 'g')")
    return strip(x)


def coerce_ts(x: str) -> str:
    """Oracle side of B1: ISO or the accepted date layouts, else NULL."""
    return (f"coalesce(try_cast({x} AS TIMESTAMP), try_strptime({x}, '%b %d, %Y'), try_strptime({x}, '%B %d, %Y'), "
            f"try_strptime({x}, '%m/%d/%Y'), try_strptime({x}, '%Y/%m/%d'))")


def valid_author(x: str) -> str:
    s = strip(x)
    junk = " OR ".join(f"contains(lower({s}), {q(t)})" for t in JUNK_TERMS)
    return (f"coalesce({ntok(s)} >= 2 AND NOT {isupper(s)} AND NOT regexp_matches({s}, '[|/#]') "
            f"AND NOT ({junk}), false)")


def tfidf_ctes(names_cte: str, prefix: str = "") -> str:
    """CTEs ``{prefix}vec(id, gram, df, weight)`` over ``names_cte(id, name)``."""
    p = prefix
    return f"""
{p}words AS (SELECT id, ' ' || w || ' ' AS w
           FROM (SELECT id, unnest(string_split_regex({strip('lower(name)')}, '\\s+')) AS w FROM {names_cte}) x
           WHERE length(w) > 0),
{p}g1 AS (SELECT id, w, unnest(generate_series(2, least(4, length(w)))) AS n FROM {p}words),
{p}g2 AS (SELECT id, w, n, unnest(generate_series(0, length(w) - n)) AS i FROM {p}g1),
{p}tf AS (SELECT id, substring(w, i + 1, n) AS gram, count(*) AS tf FROM {p}g2 GROUP BY id, substring(w, i + 1, n)),
{p}dfq AS (SELECT gram, count(*) AS df FROM {p}tf GROUP BY gram),
{p}ndoc AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS n FROM {names_cte}),
{p}raw AS (SELECT id, gram, df, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw
         FROM {p}tf JOIN {p}dfq USING (gram) CROSS JOIN {p}ndoc),
{p}nrm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM {p}raw GROUP BY id),
{p}vec AS (SELECT id, gram, df, raw / norm AS weight FROM {p}raw JOIN {p}nrm USING (id))"""


def cluster_ctes(names_cte: str, threshold: float = 0.85, prefix: str = "") -> str:
    """CTEs ``{prefix}pairs(a, b, cosine)``, ``{prefix}comp(id, comp)``,
    ``{prefix}canon(id, name, comp, canonical)`` (needs WITH RECURSIVE)."""
    p = prefix
    return tfidf_ctes(names_cte, p) + f""",
{p}pairs AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS cosine
           FROM {p}vec a JOIN {p}vec b ON a.gram = b.gram AND a.id < b.id
           GROUP BY a.id, b.id HAVING sum(a.weight * b.weight) >= {threshold} - 1e-9),
{p}edges AS (SELECT a, b FROM {p}pairs UNION ALL SELECT b, a FROM {p}pairs),
{p}reach(src, dst) AS (SELECT id, id FROM {names_cte}
                     UNION SELECT r.src, e.b FROM {p}reach r JOIN {p}edges e ON r.dst = e.a),
{p}comp AS (SELECT src AS id, min(dst) AS comp FROM {p}reach GROUP BY src),
{p}tagged AS (SELECT n.id, n.name, c.comp FROM {names_cte} n JOIN {p}comp c USING (id)),
{p}canon AS (SELECT t.id, t.name, t.comp, k.name AS canonical FROM {p}tagged t JOIN
           (SELECT comp, name FROM (SELECT comp, name, row_number() OVER (PARTITION BY comp ORDER BY length(name), id) AS r
                                    FROM {p}tagged) z WHERE r = 1) k USING (comp))"""


def item_of(line: str) -> str:
    """Reference-mode text of a marker line (after the first '.')."""
    after = f"(CASE WHEN instr({line}, '.') > 0 THEN substring({line}, instr({line}, '.') + 1) ELSE {line} END)"
    return strip(f"ltrim({strip(after)}, '- ')")


def list_items(content: str, limit: int | None = None) -> str:
    lines = f"list_transform(string_split({content}, chr(10)), lambda l: {strip('l')})"
    marked = f"list_filter({lines}, lambda l: length(l) > 0 AND regexp_matches(l, '^(\\p{{Nd}}|-)'))"
    items = f"list_filter(list_transform({marked}, lambda l: {item_of('l')}), lambda t: length(t) > 0)"
    if limit is not None:
        items = f"list_slice({items}, 1, {limit})"
    return f"coalesce({items}, [])"


def render(template: str, **slots: str) -> str:
    """A prompt template as a SQL concat of literals and slot expressions."""
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(q(literal))
        if field is not None:
            parts.append(f"coalesce(CAST({slots[field]} AS VARCHAR), 'None')")
    return "(" + " || ".join(parts) + ")"


# ---------------------------------------------------------------- HTML --

# Written out, apart from the code under test.
_CLASS = """class=["'](?:[^"']*\\s)?%s(?:\\s[^"']*)?["']"""
_BLOCK_TAG = ("(?i)(</?(?:h[1-6]|p|div|table|tbody|thead|tfoot|tr|td|th|ul|ol|li|dl|dt|dd|section|article|aside|nav|header|footer|"
              "main|figure|figcaption|blockquote|pre|form|fieldset|address|hr|body|html|head|title)\\b[^>]*>)")
_JUNK_OPEN = ("(?is)^(?:<table\\b[^>]*" + _CLASS % "navbox" + "|<ol\\b[^>]*" + _CLASS % "references" + "|<div\\b[^>]*"
              + _CLASS % "reflist" + "|<div\\b[^>]*" + _CLASS % "hatnote" + """|<div\\b[^>]*id=["']toc["'])""")
_NESTING = ("'div', 'table', 'ul', 'ol', 'dl', 'section', 'article', 'aside', 'nav', 'header', 'footer', 'main', 'figure', "
            "'blockquote', 'form', 'fieldset', 'body', 'html'")


def _html_consts():
    from quire.functions import degrees as D
    return D


def unescape(x: str) -> str:
    """Entities decoded one by one; numeric forms by their code point."""
    import html
    names = {f"&{n}": t for n, t in html.entities.html5.items()}
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in names.items()) + "}"
    entity = "'&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?'"
    latin = ("[8364, 129, 8218, 402, 8222, 8230, 8224, 8225, 710, 8240, 352, 8249, 338, 141, 381, 143, "
             "144, 8216, 8217, 8220, 8221, 8226, 8211, 8212, 732, 8482, 353, 8250, 339, 157, 382, 376]")
    code = ("CASE WHEN length(regexp_replace(rtrim(e, ';'), '^&#[xX]?0*', '')) > 8 THEN -1 "
            "WHEN e[3] IN ('x', 'X') THEN ('0x' || substr(rtrim(e, ';'), 4))::BIGINT ELSE rtrim(substr(e, 3), ';')::BIGINT END")
    good = (f"list_transform([{code}], lambda n: CASE WHEN n <= 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN n BETWEEN 128 AND 159 THEN chr({latin}[n - 127]) ELSE chr(n::INTEGER) END)[1]")
    one = f"CASE WHEN e LIKE '&#%' THEN {good} ELSE coalesce({table}[e], e) END"
    return (f"(CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(list_zip(string_split_regex({x}, {entity}), "
            f"list_transform(regexp_extract_all({x}, {entity}), lambda e: {one})), lambda z: z[1] || coalesce(z[2], '')), '') ELSE {x} END)")


def node_text(inner: str, sep: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split_regex({inner}, '<[^>]*>'), "
            f"lambda t: {strip(unescape('t'))}), lambda t: length(t) > 0), {q(sep)})")


def blocks_ctes(pages_cte: str, id_col: str = "page_id", html_col: str = "source") -> str:
    """CTEs ``kept`` (every piece outside junk), ``allb`` (every piece of the container, with its depth) and
    ``blocks(page_id, pos, kind, level, text, container)``."""
    style = "(?is)<style\\b[^>]*>.*?</style>|<script\\b[^>]*>.*?</script>|<!--.*?-->"
    sup = "(?is)<sup\\b[^>]*" + _CLASS % "reference" + "[^>]*>.*?</sup>"
    span = "(?is)<span\\b[^>]*" + _CLASS % "mw-cite-backlink" + "[^>]*>.*?</span>"
    h = f"regexp_replace(regexp_replace(regexp_replace({html_col}, {q(style)}, '', 'g'), {q(sup)}, '', 'g'), {q(span)}, '', 'g')"
    return f"""
pc AS (SELECT {id_col} AS page_id, string_split(regexp_replace({h}, {q(_BLOCK_TAG)}, chr(1) || '\\1', 'g'), chr(1)) AS pieces
       FROM {pages_cte}),
pe AS (SELECT page_id, CAST(k - 1 AS BIGINT) AS pos, pieces[k] AS piece
       FROM (SELECT page_id, pieces, unnest(generate_series(1, len(pieces))) AS k FROM pc) x),
pn AS (SELECT *, lower(regexp_extract(piece, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM pe),
pt AS (SELECT *, CASE WHEN name = '' THEN 0 WHEN piece LIKE '</%' THEN -1 ELSE 1 END AS turn FROM pn),
bal AS (SELECT page_id, name, pos, turn, piece, sum(turn) OVER (PARTITION BY page_id, name ORDER BY pos) AS s
        FROM pt WHERE name IN ('table', 'div', 'ol')),
el AS (SELECT o.page_id, o.name, o.pos, any_value(o.piece) AS piece, min(c.pos) AS close FROM bal o LEFT JOIN bal c
       ON c.page_id = o.page_id AND c.name = o.name AND c.pos > o.pos AND c.s < o.s
       WHERE o.turn = 1 GROUP BY o.page_id, o.name, o.pos),
junk AS (SELECT page_id, pos, close FROM el WHERE close IS NOT NULL AND regexp_matches(piece, {q(_JUNK_OPEN)})),
kept0 AS (SELECT p.*, EXISTS (FROM junk j WHERE j.page_id = p.page_id AND j.close = p.pos) AS ends FROM pt p
          WHERE NOT EXISTS (FROM junk j WHERE j.page_id = p.page_id AND p.pos >= j.pos AND p.pos < j.close)),
kept AS (SELECT page_id, pos, piece, CASE WHEN ends THEN '' ELSE name END AS name, CASE WHEN ends THEN 0 ELSE turn END AS turn FROM kept0),
cont AS (SELECT page_id, arg_min(pos, pos) AS a, coalesce(arg_min(coalesce(close, 1099511627776), pos), 1099511627776) AS z
         FROM el SEMI JOIN kept USING (page_id, pos)
         WHERE name = 'div' AND regexp_matches(piece, {q("(?is)^<div[^>]*" + _CLASS % "mw-parser-output")}) GROUP BY page_id),
blk AS (SELECT k.page_id, pos, c.a IS NOT NULL AS container,
               CASE WHEN turn = 1 AND regexp_matches(name, '^(p|h[1-6])$') THEN name ELSE '' END AS tag,
               regexp_replace(piece, '^<[^>]*>', '') AS inr,
               CASE WHEN name IN ({_NESTING}) AND pos IS DISTINCT FROM c.a THEN turn ELSE 0 END AS step
        FROM kept k LEFT JOIN cont c ON c.page_id = k.page_id WHERE c.a IS NULL OR (pos >= c.a AND pos < c.z)),
allb AS (SELECT page_id, pos, container, tag, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth,
                CASE WHEN tag LIKE 'h%' THEN {node_text('inr', '')} ELSE {node_text('inr', ' ')} END AS text FROM blk),
blocks AS (SELECT page_id, pos, CASE WHEN tag LIKE 'h%' THEN 'h' ELSE 'p' END AS kind,
                  CASE WHEN tag LIKE 'h%' THEN CAST(substring(tag, 2, 1) AS INTEGER) END AS level, text, container
           FROM allb WHERE tag <> '')"""


def sections_ctes() -> str:
    """After blocks_ctes: ``ibox(page_id, rk, key, value)`` and
    ``secs(page_id, title, sec_rank, pos, text)``."""
    bl = "'See also', 'References', 'External links', 'Further reading', 'Notes'"
    rows, cells = "('tr', 'tbody', 'thead', 'tfoot')", "('tr', 'tbody', 'thead', 'tfoot', 'th', 'td')"
    return f""",
att AS (SELECT b.*,
               last_value(CASE WHEN kind = 'h' THEN pos END IGNORE NULLS) OVER w AS head_pos,
               last_value(CASE WHEN kind = 'h' THEN text END IGNORE NULLS) OVER w AS head_title
        FROM blocks b
        WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hpar AS (SELECT page_id, coalesce(head_title, '_lead_') AS title, CAST(coalesce(head_pos, -1) AS BIGINT) AS sec_rank, pos, text
         FROM att WHERE kind = 'p' AND (head_pos IS NOT NULL OR container)
           AND (coalesce(head_title, '_lead_') NOT IN ({bl}) OR head_pos IS NULL)),
ib AS (SELECT page_id, arg_min(pos, pos) AS a, coalesce(arg_min(coalesce(close, 1099511627776), pos), 1099511627776) AS z
       FROM el SEMI JOIN kept USING (page_id, pos)
       WHERE name = 'table' AND regexp_matches(piece, {q("(?is)^<table[^>]*" + _CLASS % "infobox")}) GROUP BY page_id),
it AS (SELECT k.page_id, k.pos, name, turn, {node_text("regexp_replace(piece, '^<[^>]*>', '')", ' ')} AS text,
              sum(CASE WHEN name = 'table' THEN turn ELSE 0 END) OVER (PARTITION BY k.page_id ORDER BY k.pos) AS d
       FROM kept k JOIN ib ON ib.page_id = k.page_id AND k.pos BETWEEN ib.a AND ib.z),
ispan AS (SELECT o.page_id, o.pos, any_value(o.name) AS name,
                 coalesce(min(e.pos) FILTER (e.d < o.d OR (e.d = o.d AND e.name IN {rows})), 1099511627776) AS row_end,
                 coalesce(min(e.pos) FILTER (e.d < o.d OR (e.d = o.d AND e.name IN {cells})), 1099511627776) AS cell_end
          FROM it o LEFT JOIN it e ON e.page_id = o.page_id AND e.pos > o.pos
          WHERE o.turn = 1 AND o.name IN ('tr', 'th', 'td') GROUP BY o.page_id, o.pos),
icell AS (SELECT c.page_id, c.pos, any_value(c.name) AS name, coalesce(string_agg(t.text, ' ' ORDER BY t.pos) FILTER (t.text <> ''), '') AS text
          FROM ispan c JOIN it t ON t.page_id = c.page_id AND t.pos >= c.pos AND t.pos < c.cell_end
          WHERE c.name <> 'tr' GROUP BY c.page_id, c.pos),
irow AS (SELECT r.page_id, r.pos, arg_min(c.text, c.pos) FILTER (c.name = 'th') AS key, arg_min(c.text, c.pos) FILTER (c.name = 'td') AS value
         FROM ispan r JOIN icell c ON c.page_id = r.page_id AND c.pos > r.pos AND c.pos < r.row_end
         WHERE r.name = 'tr' GROUP BY r.page_id, r.pos),
ibox AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS rk, key, value
         FROM irow WHERE key IS NOT NULL AND value IS NOT NULL),
iedu AS (SELECT page_id, string_split(string_agg(value, '; ' ORDER BY rk), '; ') AS parts FROM ibox
         WHERE contains(lower(key), 'education') OR contains(lower(key), 'alma mater') GROUP BY page_id),
ipar AS (SELECT page_id, '_infobox_education_' AS title, CAST(1099511627776 AS BIGINT) AS sec_rank, CAST(k - 1 AS BIGINT) AS pos,
                {strip('parts[k]')} AS text
         FROM (SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS k FROM iedu) x),
secs AS (SELECT * FROM hpar UNION ALL SELECT * FROM ipar),
stext AS (SELECT page_id, title, sec_rank, string_agg(text, ' ' ORDER BY pos) AS text FROM secs GROUP BY page_id, title, sec_rank)"""


def word_safe(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F\\P{{L}}]', 'x', 'g'), '[^\\x00-\\x7F\\P{{N}}]', '0', 'g')"


def mentions(x: str, kind: str = "strict") -> str:
    D = _html_consts()
    return f"regexp_matches({word_safe(x)}, {q(D.PATTERNS[kind])})"


def sentences(x: str) -> str:
    D = _html_consts()
    for _ in range(2):
        x = f"regexp_replace({x}, {q(D.PROTECT)}, {q(chr(92) + '1' + chr(92) + '2' + D.KEEP + chr(92) + '3')}, 'g')"
    x = f"regexp_replace({x}, {q(D.BOUNDARY)}, {q(chr(92) + '1' + D.CUT + chr(92) + '2')}, 'g')"
    return (f"list_filter(list_transform(string_split({x}, {q(D.CUT)}), "
            f"lambda s: {strip(f'replace(s, {q(D.KEEP)}, {q(chr(46))})')}), lambda s: length(s) > 0)")
