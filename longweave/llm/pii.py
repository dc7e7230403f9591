"""Personal data: fixed patterns, and contextual patterns bootstrapped from what those find.

DataFrame and SQL functions only. One pass over the texts finds the base spans and what else may be an
identifier (words with a digit or with a sign inside, groups of digits), each with the words before it.
Base spans seed the bootstrapping: the words before a value are a lexical pattern, and patterns and
values form a graph that is scored in rounds: a pattern by the share of its values that are trusted, a
value by the trusted patterns it stands in. A value found in one round supports the other patterns that
it stands in in the next, so contexts without any base span come to be believed too. Patterns of high
confidence give the kind to values that no fixed pattern knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longweave.operators.joins import salted_join
from longweave.session import saved

#: Kinds in the order of the spans, and their patterns. Fixed values, but that repeats are possessive
#: where what follows can't be part of them, so that matching takes linear time and no stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What may be an identifier, with the signs at its ends cut off: a word with a digit and groups of digits
#: after it, or a word of letters with one of SIGNS inside. Words of letters alone are not looked at.
SIGNS = r"@._%+()\[\]<>:/\\#*=|~"
WORD = rf"(?<![^\s])(?:[^\s0-9]*+[0-9]\S*+(?: \(?[0-9][0-9().-]*+(?![^\s]))*+|[^\s0-9{SIGNS}]++[{SIGNS}]++[^\s0-9{SIGNS}]\S*+)"
#: What a text must hold for that to be tried.
NEEDS_WORD = rf"[0-9]|[^\s{SIGNS}][{SIGNS}]+[^\s{SIGNS}]"
#: A pattern is believed if so many distinct values of a kind stand in it, and so sure.
LEAST_VALUES, CONFIDENT, ROUNDS = 5, 0.8, 4
#: Characters before a value that its context is read from.
CONTEXT = 60
#: Parts whose positions are summed together; an even number.
BLOCK = 256
#: Believed patterns up to which they are broadcast, some 60 bytes each.
BROADCAST_PATTERNS = 200_000

#: Marks a match while positions are counted, and what stands for it in a text that has it itself.
_MARK, _OTHER = "\ue000", "\ue001"


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at the pattern's leftmost matches: what is before, a match, what is between, ..."""
    return F.split(F.regexp_replace(text, pattern, _MARK + "$0" + _MARK), _MARK, -1)


def _found(parts: str) -> Column:
    """Structs of start, end (code points), value and what is before, for the matches among ``parts``.

    Positions are summed block by block, so the work stays near the number of matches.
    """
    col, none = F.col(parts), "array<struct<start:int,end:int,value:string,before:string>>"

    def block(i: Column) -> Column:
        return F.slice(col, i * BLOCK + 1, F.lit(BLOCK))

    blocks = F.sequence(F.lit(0), F.floor((F.size(col) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda i: F.aggregate(block(i), F.lit(0), lambda a, x: a + F.length(x)))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("value"), acc["last"].alias("before")))
        out = F.when(acc["match"], F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct((~acc["match"]).alias("match"), end.alias("at"), F.when(acc["match"], acc["last"]).otherwise(F.substring(x, -CONTEXT, CONTEXT)).alias("last"), out.alias("out"))

    def matches(i: Column) -> Column:
        at = F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        start = F.struct(F.lit(False).alias("match"), at.alias("at"), F.lit("").alias("last"), F.array().cast(none).alias("out"))
        return F.aggregate(block(i), start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(blocks, matches))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass: from the right, every other digit doubled, less 9 above 9."""
    d = F.split(F.reverse(_digits(value)), "")
    n = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(n, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, words): base spans with kind and context, and what else may be an identifier; ``row`` is a row's number."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, _OTHER)
    none = "array<struct<start:int,end:int,value:string,before:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))

    def needed(kind: str) -> Column:
        sign = NEEDS[kind]
        return F.contains("text", F.lit(sign)) & (F.lit(True) if kind == "email" else F.col("digit")) if sign else F.col("digit")

    empty = F.array().cast("array<string>")
    parts = [F.when(needed(k), _parts(F.col("text"), PATTERNS[k])).otherwise(empty).alias(k) for k in KINDS]
    parts.append(F.when(F.col("text").rlike(NEEDS_WORD), _parts(F.col("text"), WORD)).otherwise(empty).alias("words"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *parts)
    rows = rows.select("row", "doc_id", *[F.when(F.size(k) > 1, _found(k)).otherwise(F.array().cast(none)).alias(k) for k in (*KINDS, "words")])

    def checked(kind: str) -> Column:
        own = F.filter(kind, lambda x: _valid(kind, x["value"]))
        return F.transform(own, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before")))

    rows = rows.select("row", "doc_id", "words", *[checked(k).alias(k) for k in KINDS])
    base = F.concat(*[F.col(k) for k in KINDS])
    # a word loses the signs at its ends
    lead = lambda x: F.length(F.regexp_extract(x["value"], "^[^A-Za-z0-9+]*+", 0))
    tail = lambda x: F.length(F.regexp_extract(x["value"], "[^A-Za-z0-9]*+$", 0))
    bare = F.transform("words", lambda x: F.struct((x["start"] + lead(x)).alias("start"), (x["end"] - tail(x)).alias("end"), x["value"].alias("value"), x["before"].alias("before")))
    rows = rows.select("row", "doc_id", base.alias("base"), bare.alias("words"))
    free = F.filter("words", lambda x: (x["end"] > x["start"]) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select("row", "doc_id", "base", F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before"))).alias("words"))


def _patterns(before: Column) -> Column:
    """The lexical patterns of a context: its last two words, and its last word, letters in lower case."""
    w = F.filter(F.split(F.lower(F.regexp_replace(before, r"[^\p{L}\p{N}:#=]+", " ")), " "), lambda x: x != "")
    n = F.size(w)
    two = F.when(n >= 2, F.concat_ws(" ", F.element_at(w, -2), F.element_at(w, -1)))
    one = F.when(n >= 1, F.concat(F.lit("* "), F.element_at(w, -1)))
    return F.filter(F.array(two, one), lambda x: x.isNotNull())


def bootstrapped(scan: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence): the patterns that are believed.

    Values count once for a pattern, however often copies of a text repeat them. A pattern needs
    LEAST_VALUES trusted values of a kind, seeds or values found before, so patterns with fewer values
    in all leave the graph at the start. Values are known by a hash, at any length.
    """
    key = F.md5(F.lower("x.value"))
    seeds = scan.select(F.explode("base").alias("x")).select("x.kind", key.alias("value"), _patterns(F.col("x.before")).alias("p"))
    others = scan.select(F.explode("words").alias("x")).select(F.lit(None).cast("string").alias("kind"), key.alias("value"), _patterns(F.col("x.before")).alias("p"))
    edges = seeds.unionByName(others).withColumn("pattern", F.explode("p")).groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    edges = saved(edges, "values")
    sums = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_VALUES)
    edges = saved(edges.join(sums, "pattern"), "graph")
    known = edges.where("kind IS NOT NULL").select("value", F.col("kind").alias("as_kind"), F.lit(1.0).alias("trust")).distinct()
    trust, best = known, None
    for at in range(rounds):
        got = edges.join(trust, "value").groupBy("pattern", "as_kind", "n").agg(F.sum("trust").alias("mass"), F.count(F.when(F.col("trust") >= CONFIDENT, 1)).alias("support"))
        best = saved(got.where((F.col("support") >= LEAST_VALUES) & (F.col("mass") >= CONFIDENT * F.col("n"))).select("pattern", F.col("as_kind").alias("kind"), (F.col("mass") / F.col("n")).alias("confidence")), "patterns")
        if at + 1 < rounds:
            found = edges.where("kind IS NULL").select("pattern", "value").join(best, "pattern").groupBy("value", F.col("kind").alias("as_kind")).agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("trust"))
            if not found.limit(1).count():
                break
            trust = saved(known.unionByName(found), "trust")
    return best


def discovered(scan: DataFrame, believed: DataFrame) -> DataFrame:
    """(row, more): spans of words in believed patterns, of the surest kind; ties by kind's name."""
    words = scan.where(F.size("words") > 0).select("row", F.explode("words").alias("x")).select("row", "x.start", "x.end", F.explode(_patterns(F.col("x.before"))).alias("pattern"))
    few = believed.count() <= BROADCAST_PATTERNS
    hits = words.join(F.broadcast(believed), "pattern") if few else salted_join(words, believed.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("x")).select("pattern", "x.*"), "pattern", "row")
    hits = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    return hits.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))


def _spelled(spans: Column) -> Column:
    rank = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base and all (arrays of kind, start, end).

    Start and end count code points, end exclusive. Base spans of a kind don't overlap, those of two
    kinds may. ``all`` adds the discovered spans, which overlap no base span. Null and empty texts have
    none. Repeated rows and null doc_ids stay; an empty table gives no rows; other columns aren't read.
    """
    scan = saved(scanned(docs), "scan")
    more = discovered(scan, bootstrapped(scan))
    bare = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = scan.join(more, "row", "left").withColumn("base", bare)
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("all"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, spelled out)."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans(docs).select("doc_id", *map(count, KINDS), F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"), _spelled(F.col("all")).alias("spans"))
