"""Information-theoretic sanitisation of personal data, in DataFrame operations alone.

Base findings (addresses, numbers) are the protected entities; so are the classes that
they generalise to: the domain of an address, the network of an ip, the issuer of a card
and the area of a phone number.  Words that stand near an entity, and words of an address
itself, are its candidate terms.  Over the whole corpus a term t reveals an entity e by

    P(e | t) = n(t near e) / n(t)        bits(t, e) = log2(P(e | t) / P(e))

with n counting documents.  A term exceeds the disclosure threshold if it keeps company
with the entity in enough different texts, its presence makes the entity likely, and it
carries enough bits, or most of all there are to know about it, -log2 P(e).  It is a
finding wherever it occurs, and is generalised or removed together with the entities.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract, but written without needless backtracking: a run of letters is
#: tried from its first letter only (or from the end of the match before), and loops
#: don't give back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = "^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
TERM = r"[\p{L}\p{N}]{4,}"
#: Code points on both sides of an entity whose words are its candidate terms.
CONTEXT = 80
#: Thresholds: different texts that show term and entity together, P(e | t), bits, the share
#: of an entity's own information that is as good as these, and the bits that it must have.
MIN_TEXTS, MIN_REVEAL, MIN_BITS, MIN_SHARE, MIN_OWN = 3, 0.5, 6.0, 0.9, 0.5
#: Most candidate terms that are broadcast to count them, and most revealing terms that are
#: looked for in place; more are joined by a shuffle.
BROADCAST_TERMS, IN_PLACE = 100_000, 4096
#: Matches whose places are summed up at a time.
BLOCK = 256

_SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _running(sizes: Column) -> Column:
    """Sums of an array of ints up to and without each item.

    An array grows by copying, so items are summed in blocks, and only the blocks' sums
    over all of them.
    """
    add = lambda acc, x: F.struct((acc["n"] + x).alias("n"), F.concat(acc["out"], F.array(acc["n"])).alias("out"))
    sums = lambda xs, first: F.aggregate(xs, F.struct(first.alias("n"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])
    count = F.ceil(F.size(sizes) / BLOCK).cast("int")
    block = lambda i: F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK))
    numbers = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    totals = F.transform(numbers, lambda i: F.aggregate(block(i), F.lit(0), lambda n, x: n + x))
    return F.flatten(F.zip_with(numbers, sums(totals, F.lit(0)), lambda i, first: sums(block(i), first)))


def spans_of(text: Column, pattern: Column, kind: str) -> Column:
    """Matches with their places: what ``split`` leaves between them gives the offsets."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), 1, F.size(found))
    before = _running(F.zip_with(gaps, found, lambda g, m: g + F.length(m)))
    begins = F.zip_with(before, gaps, lambda b, g: b + g)
    spans = F.zip_with(begins, found, lambda b, m: F.struct(F.lit(kind).alias("kind"), b.alias("start"), (b + F.length(m)).alias("end"), m.alias("value")).cast(_SPAN))
    return F.when(F.size(found) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(spans)


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(PART))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base findings of a text by kind, then place; a null text has none."""
    none = F.array().cast(f"array<{_SPAN}>")
    every = []
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        holds = partial(_holds, kind)
        candidates = F.filter(F.regexp_extract_all(text, pattern, F.lit(0)), lambda v: holds(v))  # noqa: B023
        there = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9][0-9 -]{11}")
        # places are worked out only where a candidate holds
        every.append(F.when(there & (F.size(candidates) > 0), F.filter(spans_of(text, pattern, kind), lambda s: holds(s["value"]))).otherwise(none))
    return F.concat(*every)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def entities(kind: Column, value: Column) -> Column:
    """Names of a finding and of the class that it generalises to."""
    low = F.lower(value)
    wide = (
        F.when(kind == "email", F.regexp_extract(low, "@(.*)$", 1))
        .when(kind == "ip", F.regexp_extract(low, r"^([0-9]+\.[0-9]+)\.", 1))
        .when(kind == "card", F.substring(F.regexp_replace(low, "[^0-9]", ""), 1, 6))
        .otherwise(F.substring(F.regexp_replace(low, "[^0-9]", ""), 1, 6))
    )
    return F.array(F.xxhash64(F.lit(1), kind, low), F.xxhash64(F.lit(2), kind, wide))


def revealing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, min_texts: int = MIN_TEXTS, min_reveal: float = MIN_REVEAL, min_bits: float = MIN_BITS) -> DataFrame:
    """Rows (term, e, reveal, bits, own) of terms beyond the disclosure threshold for an
    entity or class e: P(e | t), bits(t, e) and -log2 P(e), over all of ``docs``."""
    text = F.coalesce(col(text_col), F.lit(""))
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("t"))
    near = lambda s: _terms(F.concat_ws(" ", F.substring(F.col("text"), F.greatest(s["start"] - context, F.lit(0)) + 1, F.least(s["start"], F.lit(context))), F.substring(F.col("text"), s["end"] + 1, F.lit(context)), F.when(s["kind"] == "email", F.substring_index(s["value"], "@", 1))))
    found = keyed.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    found = materialize(found.select("t", F.transform("base", lambda s: F.struct(entities(s["kind"], s["value"]).alias("e"), near(s).alias("words"))).alias("near")))
    # a row counts once for each pair, and once for each term in company of any entity
    both = F.array_distinct(F.flatten(F.transform("near", lambda n: F.flatten(F.transform(n["e"], lambda e: F.transform(n["words"], lambda w: F.struct(e.alias("e"), w.alias("term"))))))))
    pairs = found.select("t", F.explode(both).alias("p")).groupBy("t", "p.e", "p.term").agg(F.count("*").alias("copies"))
    anywhere = found.select(F.explode(F.array_distinct(F.flatten(F.transform("near", lambda n: n["words"])))).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    company = pairs.groupBy("term", "e").agg(F.count("*").alias("texts"), F.sum("copies").alias("near")).where(F.col("texts") >= min_texts)
    # a term that keeps company with other entities too often can't reveal this one
    company = materialize(company.join(anywhere, "term").where(F.col("near") >= min_reveal * F.col("n_near")).drop("n_near"))
    candidates = materialize(company.select("term").distinct())
    n = candidates.count()
    words = keyed.select(F.explode(_terms(F.col("text"))).alias("term"))
    # the candidates' frequency over all documents
    if n <= BROADCAST_TERMS:
        counts = (words if n else words.limit(0)).join(F.broadcast(candidates), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        counts = words.groupBy("term").agg(F.count("*").alias("n_t")).join(candidates, "term")
    known = found.select(F.explode(F.array_distinct(F.flatten(F.transform("near", lambda n: n["e"])))).alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    totals = docs.agg(F.count("*").alias("n")).first()["n"] if n else 1
    own = F.log2(F.lit(totals) / F.col("n_e"))
    reveal = F.least(F.lit(1.0), F.col("near") / F.col("n_t"))
    told = company.join(counts, "term").join(known, "e").select("term", "e", reveal.alias("reveal"), (F.log2(reveal) + own).alias("bits"), own.alias("own"))
    return told.where((F.col("reveal") >= min_reveal) & (F.col("own") >= MIN_OWN) & (F.col("bits") >= F.least(F.lit(min_bits), MIN_SHARE * F.col("own"))))


def _outside(base: Column, spans: Column) -> Column:
    """Spans that touch no base finding, by their places."""
    free = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(free, lambda a, b: a["start"] - b["start"])


def _term_spans(text: Column, term: Column) -> Column:
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))
    return spans_of(text, pattern, "term")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, min_texts: int = MIN_TEXTS, min_reveal: float = MIN_REVEAL, min_bits: float = MIN_BITS, in_place: int = IN_PLACE) -> DataFrame:
    """Rows (id, t, base, terms, clean): base findings, findings of revealing terms, and the
    text with both generalised to ``[KIND]``.

    t is a hash of the text.  Null and empty texts have no findings; very long texts are
    read whole; rows that repeat count as one text for the thresholds and each get the
    same findings; a null id is kept; an empty table gives no rows; other columns are not
    read, whatever their names.  Terms that touch base findings are not reported.
    """
    keyed = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    told = materialize(revealing(docs, id_col, text_col, context, min_texts, min_reveal, min_bits).select("term").distinct())
    none = F.array().cast(f"array<{_SPAN}>")
    based = keyed.withColumn("base", base_spans(F.col("text")))
    n = told.count()
    if not n:
        out = based.withColumn("terms", none)
    elif n <= in_place:
        # a bounded list that each text is held against
        listed = F.broadcast(told.agg(F.collect_list("term").alias("told")))
        held = F.array_intersect(_terms(F.col("text")), F.col("told"))
        spans = F.flatten(F.transform(held, lambda term: _term_spans(F.col("text"), term)))
        out = based.join(listed).withColumn("terms", F.when(F.arrays_overlap(_terms(F.col("text")), F.col("told")), _outside(F.col("base"), spans)).otherwise(none)).drop("told")
    else:
        words = keyed.select("id", "t", F.explode(_terms(F.col("text"))).alias("term"))
        held = words.join(told, "term").groupBy("id", "t").agg(F.collect_set("term").alias("held")).withColumnsRenamed({"id": "i2", "t": "t2"})
        both = based.join(held, F.col("id").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2")), "left")
        spans = F.flatten(F.transform(F.coalesce("held", F.array().cast("array<string>")), lambda term: _term_spans(F.col("text"), term)))
        out = both.withColumn("terms", _outside(F.col("base"), spans))
    return out.select("id", "t", "base", "terms", generalised(F.col("text"), F.concat("base", "terms")).alias("clean"))


def generalised(text: Column, spans: Column, remove: bool = False) -> Column:
    """A text with its findings generalised to ``[KIND]``, or removed.

    Of overlapping findings the one that begins first counts, and of those the longest.
    """
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    label = (lambda s: F.lit("")) if remove else (lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    pieces = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), pieces.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(s))).alias("out"))
        return F.when(s["start"] >= acc["at"], grown).otherwise(acc)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))


def sanitise(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: bool = False) -> DataFrame:
    """Rows (id, text): ``docs`` with the findings of ``find`` generalised, or removed.

    A null text comes out empty; rows without findings keep their text; repeated rows have
    a row each; an empty table gives none.
    """
    keyed = docs.select(col(id_col).cast("long").alias("i2"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("t2", F.xxhash64("text"))
    both = keyed.join(findings.select("id", "t", "base", "terms").dropDuplicates(["id", "t"]), F.col("i2").eqNullSafe(F.col("id")) & (F.col("t2") == F.col("t")), "left")
    none = F.array().cast(f"array<{_SPAN}>")
    return both.select(F.col("i2").alias("id"), generalised(F.col("text"), F.concat(F.coalesce("base", none), F.coalesce("terms", none)), remove).alias("text"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
