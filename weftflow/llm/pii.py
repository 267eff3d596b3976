"""Personal data in texts by bootstrapped contextual extraction, in DataFrame functions only.

Four kinds of identifiers that have a form of their own are the seeds. Words beside an identifier are lexical patterns: the word before
it, the two before it, the word after it, and the words on both sides. Patterns and instances (identifiers by value, in any writing) make up
a graph, which is scored in turns: a pattern's confidence in a kind is the sum of its instances' scores for the kind over the number of all
its instances, where at least LEAST_SEEDS of score must stand; an instance's score is the confidence of its best pattern. Instances are
also such writings as no seed has: numbers with other separators or without a plus, addresses with `(at)` and `(dot)`, dotted numbers
with brackets. Those that a pattern of at least LEAST_CONFIDENCE vouches for, or that write a seed's value in another way, are found as well.
Counts are of different values, so copies of a text add nothing to a pattern.

The text is scanned once; a document keeps its matches with short contexts, and positions are sums over the gaps between matches.
Spans are code points, end exclusive. Patterns for long texts are possessive and begin only where a run begins, so that scans stay linear.

Nulls: a null text counts as empty. Repeated rows and ids, null ids included, are documents each. Extra columns, whatever their names, are
left behind. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Different seeds that a pattern stands beside, at least, and the confidence from which on it vouches for an instance.
LEAST_SEEDS, LEAST_CONFIDENCE = 5, 0.9
#: Times that the graph is scored; code points of context on either side.
TURNS, CONTEXT = 3, 48
#: Parts into which the instances of a frequent pattern are dealt.
SALTS = 16

#: Of each kind its form, and what a text needs to hold one.
BASE = (
    (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    (r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){12}[0-9]"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
#: Writings that only their context tells: addresses with words for signs, and numbers in groups.
AT, DOT = (rf"\x20?[(\[{{<]\x20?(?:{w}|{w.upper()})\x20?[)\]}}>]\x20?" for w in ("at", "dot"))
OPEN = (
    (rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++(?:@|{AT})[\p{{L}}\p{{N}}-]++(?:(?:\.|{DOT})[\p{{L}}\p{{N}}-]++)*+", rf"@|{AT}"),
    (r"(?<![\p{L}\p{N}])[(+]{0,2}[0-9]++(?:[\x20().\[\]/:_-]{1,3}[0-9]++)*+", r"(?:[0-9][\x20().\[\]/:_-]{0,3}){6}[0-9]"),
)
ADDRESS, NUMBER = 4, 5
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
WHOLE_IP = rf"\A{PART}\.{PART}\.{PART}\.{PART}\z"

MENTION = "array<struct<kind int, k int, gap int, value string, before string, after string>>"


def matches(text: Column, kind: int, pattern: str, need: str) -> Column:
    """The matches of a text in order, as an array of MENTION; `gap` is the number of code points since the match before."""
    holds = F.contains(text, F.lit(need)) if need in ("@", "+") else F.rlike(text, F.lit(need))
    between = F.split(text, pattern, -1)
    each = F.arrays_zip(between.alias("b"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.slice(between, F.lit(2), F.greatest(F.size(between), F.lit(1))).alias("a"))
    short = lambda f, x: f(x, F.lit(CONTEXT))
    one = lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("k"), F.char_length(x["b"]).alias("gap"), x["m"].alias("value"), short(F.right, x["b"]).alias("before"), short(F.left, x["a"]).alias("after")
    )
    return F.when(holds, F.transform(F.filter(each, lambda x: x["m"].isNotNull()), one)).otherwise(F.array().cast(MENTION)).cast(MENTION)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the check: from the right every second digit counts twice, less nine above nine, and the sum ends in zero."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def is_valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base form is an identifier."""
    n = F.length(digits(value))
    return (
        F.when(kind == IP, F.rlike(value, F.lit(WHOLE_IP)))
        .when(kind == CARD, F.when(n.between(13, 19), luhn(digits(value))).otherwise(False))
        .when(kind == PHONE, n.between(9, 15)).otherwise(kind == EMAIL)
    )


def meaning(kind: Column, value: Column) -> Column:
    """What all writings of an identifier have in common."""
    address = F.regexp_replace(F.regexp_replace(F.lower(value), AT, "@"), DOT, ".")
    dotted = F.regexp_replace(value, r"[\x20()\[\]]", "")
    number = F.when(F.rlike(dotted, F.lit(WHOLE_IP)), F.regexp_replace(dotted, r"(?<![0-9])0+(?=[0-9])", "")).otherwise(digits(value))
    return F.when(kind.isin(EMAIL, ADDRESS), address).otherwise(number)


def may_be(kind: Column, value: Column) -> Column:
    """The kinds that an open writing can be of."""
    n = F.length(digits(value))
    number = F.array_compact(F.array(F.when(n.between(13, 19), CARD), F.when(n.between(7, 15), PHONE)))
    return F.when(kind == ADDRESS, F.array(F.lit(EMAIL))).when(F.rlike(meaning(kind, value), F.lit(WHOLE_IP)), F.array(F.lit(IP))).otherwise(number)


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns around a mention; words more than four other characters away, or on another line, don't count."""
    left = F.when(F.rlike(before, F.lit(r"\p{L}[^\p{L}\n]{0,4}\z")), F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}+"), 0))
    right = F.when(F.rlike(after, F.lit(r"\A[^\p{L}\n]{0,4}\p{L}")), F.regexp_extract(F.lower(after), r"\p{L}+", 0))
    one, two = F.element_at(left, -1), F.when(F.size(left) > 1, F.concat_ws(" ", F.element_at(left, -2), F.element_at(left, -1)))
    return F.array_compact(F.array(F.concat(one, F.lit(" _")), F.concat(two, F.lit(" _")), F.concat(F.lit("_ "), right), F.concat(one, F.lit(" _ "), right)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, mentions) of each document: the only pass over its text."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("row", "id", F.concat(*(matches(text, k, *form) for k, form in enumerate((*BASE, *OPEN)))).alias("mentions"))


def mentions(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, meaning, kinds, patterns): base identifiers (kinds null), and open writings that touch none, with the kinds that they can be of."""
    each = scanned.select("row", F.inline("mentions"))
    end = F.sum(F.col("gap") + F.char_length("value")).over(Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    at = each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
    is_open = F.col("kind") >= ADDRESS
    kinds = F.when(is_open, may_be(F.col("kind"), F.col("value")))
    apart = ~F.rlike("after", F.lit(r"\A[\p{L}\p{N}]"))
    kept = at.withColumn("kinds", kinds).filter(F.when(is_open, (F.size("kinds") > 0) & apart).otherwise(is_valid(F.col("kind"), F.col("value"))))
    order = Window.partitionBy("row").orderBy("start", "kind")
    ended = F.max(F.when(~is_open, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    begins = F.min(F.when(~is_open, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    free = kept.withColumn("ended", ended).withColumn("begins", begins)
    free = free.filter(~is_open | ((F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("begins", F.col("end")) >= F.col("end"))))
    return free.select("row", "kind", "start", "end", meaning(F.col("kind"), F.col("value")).alias("meaning"), "kinds", patterns(F.col("before"), F.col("after")).alias("patterns"))


def scores(found: DataFrame, least_seeds: float = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE, turns: int = TURNS) -> DataFrame:
    """(meaning, kind, score) of all instances: seeds have 1, others the confidence of their best pattern, once it is high enough."""
    seeds = cut(found.filter(F.col("kind") < ADDRESS).groupBy("meaning").agg(F.min("kind").alias("seed")), "seeds")
    edges = cut(found.select(F.explode("patterns").alias("pattern"), "meaning").distinct().join(seeds, "meaning", "left"), "edges")
    # of the patterns only those count that stand beside enough seeds of one kind
    strong = edges.filter("seed is not null").groupBy("pattern", "seed").count().filter(F.col("count") >= least_seeds).select("pattern").distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).join(strong, "pattern")
    sizes = cut(sizes, "sizes")
    salt = F.pmod(F.xxhash64("meaning"), F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    graph = cut(edges.withColumn("salt", salt).join(sizes.select("pattern", salts), ["pattern", "salt"]), "graph")
    known = seeds.select("meaning", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    now, done = known, []
    for turn in range(turns):
        sums = graph.join(now, "meaning").groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).filter(F.col("sum") >= least_seeds)
        sure = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / F.col("size")).alias("confidence")).filter(F.col("confidence") >= least_confidence)
        unseen = graph.filter("seed is null").join(sure.select("*", salts), ["pattern", "salt"]).groupBy("meaning", "kind").agg(F.max("confidence").alias("score"))
        now = cut(known.unionAll(unseen.select("meaning", "kind", "score")), f"scores-{turn}")
        done.append(now)
    drop(edges, graph, sizes, *done[:-1])
    return now


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_seeds: float = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(id_col, spans) of each document: an array of (kind, start, end, base) by kind and start; `base` is false for what only the method finds."""
    scanned = cut(scan(docs, id_col, text_col), "scanned")
    found = cut(mentions(scanned), "mentions")
    scored = scores(found, least_seeds, least_confidence)
    base = found.filter(F.col("kind") < ADDRESS).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    unseen = found.filter(F.col("kind") >= ADDRESS).select("row", "start", "end", "meaning", "kinds")
    met = unseen.join(scored, "meaning").filter(F.array_contains("kinds", F.col("kind")))
    best = met.groupBy("row", "start", "end").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind")).select("row", "kind", "start", "end", F.lit(False).alias("base"))
    spans = base.unionAll(best).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    named = F.transform(F.coalesce("spans", F.array().cast("array<struct<kind int, start long, end long, base boolean>>")), lambda x: x.withField("kind", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)))
    return scanned.select("row", "id").join(spans, "row", "left").select(F.col("id").alias(id_col), named.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first stands."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["end"] - a["end"]).cast("int")))
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], part(s["at"], x["start"]), F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at")))
    return F.aggregate(by_place, start, step, lambda s: F.concat(s["out"], part(s["at"], F.char_length(text).cast("long"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: (x["kind"] == kind) & x["base"])).cast("long")
