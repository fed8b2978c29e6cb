"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks; they
always stay.  On top of them high-recall generators propose further, possibly
overlapping spans: disguised addresses, colon-separated hexadecimal addresses,
digit groups without a plus.  Whether a proposal is added is for boosted trees
(Spark ML) to say.  They learn what personal data look like from every span
of two sorts: base spans, and matches that are none (base patterns that
fail their check, and the numbers, times, versions and "at" phrases of the texts,
which plain patterns find where nothing else does).  Proposals are in neither.

So that what is learnt of base spans holds for proposals, the features leave out
what only defines a base pattern: the kind, the plus, the signs between the
parts and their number.  They are counts of digits and letters, the sizes of
parts, and the context: hint words, edges, digits beside; a tree's node sees half
of them, so that no single one decides.  For each kind, the threshold is the lowest
probability above which at least ``precision`` of the held-out spans (a fifth) of
that kind are base spans (the middle of the gap to the next lower one, at least a
half); a kind without both sorts adds nothing.
Spans of equal features are one weighted row of the training; both sorts weigh
the same in all.  Proposals at or over it that overlap no base span of any kind and no stronger
proposal (of equal ones: the earlier, then the longer) are added.

Positions are code points, from the lengths of the pieces between matches.  A
null or empty text has no span; an empty list's digest is that of the empty
string.  A very long text is one row of a task.  Rows equal in id and text are one
document and get the same spans.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import documents_of, stored, text_key

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
TREES, DEPTH = 20, 3
SEEN = 24  # code points of context

# The base patterns.  Possessive forms and look-behinds find the
# same matches in one step per character.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators by the kind that they propose.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])[(]?[0-9]{2,5}[)]?[\x20./-][0-9(][\x20()./0-9-]{3,}[0-9]",
}
#: What texts hold that looks alike and is no personal data, by the kind that it resembles.
PLAIN = {
    "email": r"(?<![A-Za-z])[A-Za-z]++\x20(?:at|At|AT)\x20[A-Za-z]++|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-])",
    "ip": r"(?<![0-9A-Za-z.:])[0-9]++(?:[.:][0-9]++){1,2}(?![0-9.:])|(?<![0-9.])[0-9]++(?:\.[0-9]++){4,}+",
    "phone": r"(?<![0-9A-Za-z+.])[0-9]++(?:[\x20,/-][0-9]++)*+(?![0-9A-Za-z])",
}
RAW, PROPOSED, OTHER = 0, 1, 2  # sorts of matches: of BASE, MORE, PLAIN
#: A text without this cannot match.
NEEDS = {"email": "[@(\\[]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
NEEDS_PLAIN = {"email": "@| [aA][tT] ", "ip": "[0-9]", "phone": "[0-9]"}
HINTS = r"(?i)mail|phone|tel|call|fax|card|address|contact|host|server|reach|write"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The check of a base match; a failing match is dropped."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(p: Column) -> Column:
            p = F.regexp_replace(p, "^0+", "")
            return F.when(F.length(p) > 3, False).otherwise(F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return n.between(8, 15)


SPAN = "struct<kind:int,sort:int,base:boolean,start:bigint,end:bigint,m:string,before:string,after:string>"


def _found(kind: str, pattern: str, sort: int) -> Column:
    """The matches of a pattern in ``text`` with place and context."""
    no = KINDS.index(kind)
    gaps, matches = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"),
                         F.slice(gaps, F.lit(2), F.size(matches)).alias("n"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.from_json(F.lit("[]"), f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        g, m, n = x["g"], x["m"], x["n"]
        begin = acc["at"] + F.length(g)
        end = begin + F.length(m)
        ok = _valid(kind, m) if sort == RAW else F.lit(False)
        one = F.struct(F.lit(no).alias("kind"), F.lit(sort).alias("sort"), ok.alias("base"), begin.alias("start"), end.alias("end"), m.alias("m"),
                       F.substring(g, -SEEN, SEEN).alias("before"), F.substring(n, 1, SEEN).alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one.cast(SPAN)).alias("out"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    needs = (NEEDS_PLAIN if sort == OTHER else NEEDS)[kind]
    return F.when(F.col("text").isNotNull() & F.col("text").rlike(needs), found).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans: all matches of every sort in every row."""
    texts = documents_of(docs).withColumn("key", text_key())
    parts = [_found(k, p, sort) for sort, patterns in ((RAW, BASE), (PROPOSED, MORE), (OTHER, PLAIN)) for k, p in patterns.items()]
    return texts.select("doc_id", "key", F.concat(*parts).alias("spans"))


FEATURES = ("digits", "letters", "longest", "last", "edge_before", "edge_after", "hint", "digit_near")


def features(spans: DataFrame) -> DataFrame:
    """Format and context of exploded spans (column ``s``)."""
    before, after = F.col("s.before"), F.col("s.after")
    # disguises of the signs are no parts
    plain = F.regexp_replace("s.m", r"(?i)\x20?[(\[](?:at|dot)[)\]]\x20?", ".")
    parts = F.filter(F.split(plain, "[^0-9A-Za-z]+"), lambda x: x != "")
    sizes = F.transform(parts, lambda x: F.length(x))
    count = lambda pattern: F.regexp_count(plain, F.lit(pattern)).cast("double")
    own = {"digits": count("[0-9]"), "letters": count("[A-Za-z]"),
           "longest": F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
           "last": F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)).cast("double"),
           "edge_before": ((before == "") | before.rlike(r"[\s(:,;]$")).cast("double"),
           "edge_after": ((after == "") | after.rlike(r"^[\s),;.]")).cast("double"),
           "hint": (before.rlike(HINTS) | after.rlike(HINTS)).cast("double"),
           "digit_near": F.concat(F.substring(before, -2, 2), F.substring(after, 1, 2)).rlike("[0-9]").cast("double")}
    return spans.select("*", *[c.alias(n) for n, c in own.items()])


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def thresholds(tested: DataFrame, precision: float) -> dict[int, float]:
    """Per kind the lowest probability from which on enough of ``tested``
    (kind, label, w, p) are base spans."""
    by = (tested.select("kind", "label", "w", F.round("p", 3).alias("p")).groupBy("kind", "p")
          .agg(F.sum(F.col("label") * F.col("w")).alias("yes"), F.sum("w").alias("all")).orderBy(F.desc("p")).collect())  # at most 4,004 rows
    out: dict[int, float] = {}
    for kind in {r["kind"] for r in by}:
        rows = [r for r in by if r["kind"] == kind]
        yes = seen = 0.0
        for r, lower in zip(rows, [*(r["p"] for r in rows[1:]), 0.0]):
            yes, seen = yes + r["yes"], seen + r["all"]
            if yes >= precision * seen:
                out[kind] = max(0.5, (r["p"] + lower) / 2)
    return out


def added_spans(found: DataFrame, precision: float = PRECISION) -> DataFrame | None:
    """a_id, a_key, added: what the trees add to the base spans."""
    of = lambda test: F.filter("spans", test)
    clear = lambda s, other: ~F.exists(other, lambda b: _overlaps(s, b))
    both = found.where(F.size("spans") > 0).withColumn("sure", of(lambda s: s["base"]))
    both = both.withColumn("more", F.filter("spans", lambda s: (s["sort"] == PROPOSED) & clear(s, "sure")))
    # matches that are nothing: failing base patterns, and plain ones outside all others
    both = both.withColumn("failed", of(lambda s: (s["sort"] == RAW) & ~s["base"] & clear(s, "sure") & clear(s, "more")))
    both = both.withColumn("none", F.concat("failed", of(
        lambda s: (s["sort"] == OTHER) & clear(s, "sure") & clear(s, "more") & clear(s, "failed"))))
    rows = stored(features(both.select("doc_id", "key", F.explode(F.concat("sure", "more", "none")).alias("s"))))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="v")
    known = rows.where(F.col("s.sort") != PROPOSED).select(
        F.col("s.kind").alias("kind"), F.col("s.base").cast("double").alias("label"), *FEATURES,
        F.xxhash64("doc_id", "key", "s.start", "s.kind").alias("h"))
    like = ["kind", "label", "held", *FEATURES]
    counted = known.withColumn("held", F.expr("pmod(h, 5) = 0")).groupBy(*like).agg(F.count(F.lit(1)).alias("n"))
    spans = stored(vectors.transform(counted).repartition(32, *like).sortWithinPartitions(*like))
    total = {r["label"]: r["n"] for r in spans.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(total) < 2:
        return None
    share = F.when(F.col("label") == 1, 1.0 / total[1.0]).otherwise(1.0 / total[0.0]) * (sum(total.values()) / 2)
    spans = spans.withColumn("w", F.col("n") * share)
    fit, test = spans.where("NOT held"), spans.where("held")
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="w", maxIter=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", seed=7).fit(fit)
    chance = vector_to_array("probability")[1].alias("p")
    both_sorts = {r["kind"] for r in spans.groupBy("kind").agg(F.count_distinct("label").alias("n")).where("n > 1").collect()}
    least = {k: p for k, p in thresholds(model.transform(test).select("kind", "label", "w", chance), precision).items() if k in both_sorts}
    if not least:
        return None
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("s.kind"))
    strong = (model.transform(vectors.transform(rows.where((F.col("s.sort") == PROPOSED) & F.col("s.kind").isin(*least))))
              .select("doc_id", "key", "s", chance).where(F.col("p") >= limit).dropDuplicates(["doc_id", "key", "s"]))
    listed = strong.groupBy("doc_id", "key").agg(F.collect_list(F.struct(
        F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "p")).alias("all"))
    stronger = lambda a, b: (b["p"] > a["p"]) | ((b["p"] == a["p"]) & (
        (b["start"] < a["start"]) | ((b["start"] == a["start"]) & ((b["end"] > a["end"]) | ((b["end"] == a["end"]) & (b["kind"] < a["kind"]))))))
    best = F.filter("all", lambda a: ~F.exists("all", lambda b: _overlaps(a, b) & stronger(a, b)))
    return listed.select(F.col("doc_id").alias("a_id"), F.col("key").alias("a_key"),
                         F.transform(best, lambda a: F.struct(a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end"))).alias("added"))


def _text_of(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(i: int):
    """A condition of one argument: a second one would be given the place in the list."""
    return lambda s: s["kind"] == i


def pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans; also span_list (kind number, start, end)."""
    found = stored(candidates(docs))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = found.select("doc_id", "key", F.transform(F.filter("spans", lambda s: s["base"]), plain).alias("base"))
    added = added_spans(found)
    if added is None:
        joined = base.withColumn("added", F.filter("base", lambda s: F.lit(False)))
    else:
        joined = base.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("key") == F.col("a_key")), "left")
    every = F.concat("base", F.coalesce("added", F.filter("base", lambda s: F.lit(False))))
    n = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select("doc_id", *n, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(every).alias("spans"),
                         F.array_sort(every).alias("span_list"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets."""
    spans = pii(docs).select(F.col("doc_id").alias("s_id"), "span_list").dropDuplicates(["s_id", "span_list"])
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    cut = F.aggregate("span_list", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), lambda acc, s: F.when(
        s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                                           F.element_at(name, s["kind"] + 1)).alias("out"))))
    by_place = F.array_sort(F.transform("span_list", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = documents_of(docs).join(spans.withColumn("span_list", by_place), F.col("doc_id").eqNullSafe(F.col("s_id")), "left")
    rest = lambda c: F.concat(c["out"], F.substring(F.col("text"), (c["at"] + 1).cast("int"), F.length("text")))
    return joined.select("doc_id", F.when(F.size("span_list") > 0, rest(cut)).otherwise(F.col("text")).alias("text"))
