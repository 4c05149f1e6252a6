"""PII: base patterns, and terms that disclose the entities they stand beside.

Only DataFrame functions are used. Base spans are the matches of four patterns, leftmost and
non-overlapping for each kind; matches that fail their kind's check are dropped without a retry. Offsets are
code points, ends exclusive.

Terms: runs of letters and digits with a letter, lower-cased, that no base span touches. A term co-occurs with an entity (the value
of a base span) where it is one of the five nearest on either side, however far that is. Over the whole corpus, with n(t) texts
that hold the term anywhere, n(e) that hold the entity, n(t, e) in which they co-occur and N texts,
PMI = log(N n(t, e) / (n(t) n(e))) tells how strongly the term reveals the entity, up to the entity's own
information IC = log(N / n(e)). Few observations prove little: with s different surroundings (the ten nearest terms together) of the
pair, n(t, e) is lowered by CAUTION / s of itself (as if one were left out), so one surrounding, or copies of one passage, disclose
nothing, and two or three do where the term stands hardly anywhere else. Terms with such a PMI >= IC / GENERALISE are generalised, with PMI >= IC / REMOVE
removed, in every text that holds the entity. Their spans are of a fifth kind, term, and never overlap a base span.

Time and memory are linear in a text's length and matches: arrays are walked in blocks, texts are cut through an index of chunks.

A null text is an empty one. Equal texts have equal spans. Repeated rows each give a row. Empty tables give empty
results. All columns are kept; pii_spans and clean_text are replaced if they exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let, walk
from .common import Scratch, spread_join, table

KINDS = ("email", "ip", "card", "phone", "term")
#: Matches as the plain patterns give: a run that can't start a match is entered only at its first character
#: (or where the last match ended), and no repetition gives back characters that it can't need to.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # runs of fewer digits fail the check
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]+"
NEAR_TERMS = 5
CAUTION = 1.0
GENERALISE, REMOVE = 1.25, 1.05
#: Code points of a chunk of text.
CHUNK = 1024
#: Terms in a bucket of a text's list of terms.
BUCKET = 16
#: A letter that stands for the characters of base spans; words with it are no terms.
MASK = "\ua015"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(_SPAN)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text, from its chunks."""

    def piece(k: Column) -> Column:
        a = F.greatest(start - k * CHUNK, F.lit(0))
        return F.substr(F.element_at(parts, k + 1), a + 1, F.least(end - k * CHUNK, F.lit(CHUNK)) - a)

    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), piece), "")).otherwise("")


def found_in(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern as spans; the pieces between them give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda gap, value: F.struct(F.coalesce(F.char_length(gap), F.lit(0)).alias("gap"), F.char_length(value).alias("n"), value.alias("value")))
    return let(
        F.filter(parts, lambda p: p["value"].isNotNull()),
        lambda items: walk(
            items,
            F.lit(0),
            lambda at, p: at + p["gap"] + p["n"],
            lambda at, p: F.struct((at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["n"]).alias("end"), p["value"].alias("value")),
            _SPAN,
        ),
    )


def matches(text: str, pattern: str, kind: int, valid) -> Column:
    """Valid spans of one kind in a column."""
    return F.when(F.col(text).rlike(pattern), F.filter(found_in(F.col(text), pattern, kind), lambda s: valid(s["value"]))).otherwise(no_spans())


def is_ip(value: Column) -> Column:
    def part(p: Column) -> Column:
        short = F.regexp_replace(p, "^0+", "")
        return (F.char_length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), part)


def is_card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    n = F.char_length(digits)

    def luhn(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).try_cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return n.between(14, 19) & (F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(19)) - 1), F.lit(0), luhn) % 10 == 0)


def is_phone(value: Column) -> Column:
    return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)


def base_spans(text: str) -> Column:
    """All base spans of a text column by start, then kind."""
    has = lambda c: F.contains(F.col(text), F.lit(c))
    email = F.when(has("@"), matches(text, EMAIL, 0, lambda v: F.lit(True))).otherwise(no_spans())
    phone = F.when(has("+"), matches(text, PHONE, 3, is_phone)).otherwise(no_spans())
    return F.array_sort(F.concat(email, matches(text, IP, 1, is_ip), matches(text, CARD, 2, is_card), phone))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t.rlike(r"\p{L}") & ~F.contains(t, F.lit(MASK)))


_GAP = "array<struct<from:int,to:int,span:struct<start:int,kind:int,end:int,value:string>>>"


def gaps(spans: Column) -> Column:
    """Of each span, by start, the characters before it that no earlier one covers ([from, to), empty in an overlap)."""
    return walk(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(at.alias("from"), F.greatest(at, s["start"]).alias("to"), s.alias("span")), _GAP)


def farthest(spans: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))


def near_terms(text: Column, spans: Column) -> Column:
    """(entity, terms) of each span: the five nearest terms on either side, in order."""
    size = F.char_length(text)

    def from_gaps(parts: Column, between: Column) -> Column:
        # words that touch a base span are cut off at the gap's ends
        whole = lambda x, head: F.regexp_replace(F.when(head, F.regexp_replace(x, f"^{WORD}", "")).otherwise(x), f"{WORD}$", "")
        before = F.transform(between, lambda g, i: F.struct(g["span"].alias("span"), terms_of(whole(cut(parts, g["from"], g["to"]), i > 0)).alias("terms")))
        end = farthest(spans)
        after = terms_of(F.regexp_replace(cut(parts, end, size), f"^{WORD}", ""))
        return let(before, lambda b: let(F.flatten(F.concat(F.transform(b, lambda x: x["terms"]), F.array(after))), lambda terms: beside(b, terms)))

    def beside(before: Column, terms: Column) -> Column:
        counted = walk(before, F.lit(0), lambda n, x: n + F.size(x["terms"]), lambda n, x: F.struct(x["span"].alias("span"), (n + F.size(x["terms"])).alias("n")), "array<struct<span:struct<start:int,kind:int,end:int,value:string>,n:int>>")

        def one(x: Column) -> Column:
            entity = F.concat_ws(":", x["span"]["kind"].cast("string"), F.lower(x["span"]["value"]))
            left = F.slice(terms, F.greatest(x["n"] - NEAR_TERMS, F.lit(0)) + 1, F.least(x["n"], F.lit(NEAR_TERMS)))
            return F.struct(entity.alias("entity"), F.concat(left, F.slice(terms, x["n"] + 1, F.lit(NEAR_TERMS))).alias("terms"))

        return F.transform(counted, one)

    return let(chunks(text), lambda parts: let(gaps(spans), lambda between: from_gaps(parts, between)))


def surroundings(keyed: DataFrame) -> DataFrame:
    """(key, entity, around, terms) of each base span of key, text, spans."""
    near = keyed.select("key", F.inline(near_terms(F.col("text"), F.col("spans"))))
    return near.select("key", "entity", F.xxhash64("terms").alias("around"), "terms")


def disclosing(keyed: DataFrame, near: DataFrame, caution: float, scratch: Scratch) -> DataFrame:
    """(entity, term, remove): the terms beyond a threshold. keyed: key, text, one row for each row of the corpus."""
    told = near.select("key", "entity", "around", F.explode(F.array_distinct("terms")).alias("term"))
    apart = told.select("entity", "term", "around").distinct().groupBy("entity", "term").agg(F.count("*").alias("apart")).where(F.col("apart") > caution)
    n_e = near.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    n = keyed.select(F.countDistinct("key").alias("n"))
    ic = F.ln(F.col("n") / F.col("n_e"))
    # a term lies in no fewer texts than it is near any entity in: what fails with those fails with all
    least = told.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = told.join(apart, ["entity", "term"]).select("key", "entity", "term", "apart").distinct().groupBy("entity", "term", "apart").agg(F.count("*").alias("n_te"))
    pairs = pairs.join(n_e, "entity").join(least, "term").join(F.broadcast(n))  # n is one row

    def pmi(count: str) -> Column:
        sure = F.col("n_te") * (1 - F.lit(caution) / F.col("apart"))
        return F.ln(F.col("n") * sure / (F.col(count) * F.col("n_e")))

    def possible(count: str) -> Column:
        return (ic > 0) & (pmi(count) >= ic / GENERALISE)

    def counted(texts: DataFrame, terms: DataFrame) -> DataFrame:
        held = texts.select("key", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
        return held.distinct().groupBy("term").agg(F.count("*").alias("n_t"))

    pairs = scratch.table(pairs.where(possible("n_near")), "co-occurrence")
    # neither does it lie in fewer than in a sixteenth of the texts, which is soon counted
    some = counted(keyed.where(F.pmod(F.xxhash64("key"), F.lit(16)) == 0), pairs)
    pairs = pairs.join(some, "term", "left").withColumn("n_near", F.greatest("n_near", F.coalesce("n_t", F.lit(0))))
    pairs = scratch.table(pairs.where(possible("n_near")).drop("n_near", "n_t"), "co-occurrence")
    scored = pairs.join(counted(keyed, pairs), "term").where(possible("n_t"))
    return scored.select("entity", "term", (pmi("n_t") >= ic / REMOVE).alias("remove"))


def masked(text: Column, spans: Column) -> Column:
    """The text with a letter for each character of the spans, so that no word there or touching them is found."""

    def join(parts: Column, between: Column) -> Column:
        pieces = F.transform(between, lambda g: F.concat(cut(parts, g["from"], g["to"]), F.repeat(F.lit(MASK), F.greatest(g["span"]["end"] - g["to"], F.lit(0)))))
        return F.concat(F.array_join(pieces, ""), cut(parts, farthest(spans), F.char_length(text)))

    return let(chunks(text), lambda parts: let(gaps(spans), lambda between: join(parts, between)))


def term_spans(text: Column, spans: Column, terms: Column) -> Column:
    """Spans of the terms (lower-cased words) in a text, outside the given spans."""
    n = F.greatest(F.ceil(F.size(terms) / BUCKET).cast("int"), F.lit(1))
    bucket = lambda t, k: F.pmod(F.hash(t), k)
    buckets = lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.filter(F.transform(terms, lambda t: t["term"]), lambda t: bucket(t, k) == i))
    words = found_in(masked(text, spans), WORD, 4)

    def among(held: Column) -> Column:
        return F.filter(words, lambda w: F.array_contains(F.element_at(held, bucket(F.lower(w["value"]), F.size(held)) + 1), F.lower(w["value"])))

    return F.when(F.size(terms) > 0, let(buckets(n), among)).otherwise(no_spans())


_TERMS = "array<struct<term:string,remove:boolean>>"


def find_pii(docs: DataFrame, text_col: str = "text", caution: float = CAUTION) -> DataFrame:
    """docs with __tf_text, __tf_spans (base spans), pii_spans (start, kind, end, value; by start, then kind) and __tf_removed, the
    terms to remove. The base spans are found once and written with the rows; only rows that have some are joined with terms."""
    docs = docs.drop("pii_spans", "clean_text")
    columns = docs.columns
    with Scratch(docs.sparkSession) as scratch:
        spotted = docs.withColumn("__tf_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("__tf_spans", base_spans("__tf_text"))
        spotted = scratch.kept(spotted.drop("__tf_text"), "base-spans")
        at = spotted.withColumn("__tf_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        key = F.md5(F.col("__tf_text").cast("binary"))
        keyed = at.select(key.alias("key"), F.col("__tf_text").alias("text"))
        some = F.size("__tf_spans") > 0
        near = scratch.table(surroundings(at.where(some).select(key.alias("key"), F.col("__tf_text").alias("text"), F.col("__tf_spans").alias("spans"))), "surroundings")
        found = scratch.table(disclosing(keyed, near, caution, scratch), "disclosing-terms")
        by_text = near.select("key", "entity").distinct().join(found, "entity").groupBy("key").agg(F.collect_set(F.struct("term", "remove")).alias("__tf_terms"))
        counts = at.where(some).select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        terms = scratch.kept(by_text.join(counts, "key").withColumnRenamed("key", "__tf_key"), "terms-by-text")
        total = at.where(some).count()
    without = at.where(~some).withColumn("pii_spans", no_spans()).withColumn("__tf_removed", F.array().cast("array<string>"))
    joined = spread_join(at.where(some).withColumn("__tf_key", key), terms, ["__tf_key"], total, "left").withColumn("__tf_terms", F.coalesce("__tf_terms", F.array().cast(_TERMS)))
    joined = joined.withColumn("pii_spans", F.array_sort(F.concat("__tf_spans", term_spans(F.col("__tf_text"), F.col("__tf_spans"), F.col("__tf_terms")))))
    joined = joined.withColumn("__tf_removed", F.transform(F.filter("__tf_terms", lambda t: t["remove"]), lambda t: t["term"]))
    names = [*columns, "__tf_text", "__tf_spans", "pii_spans", "__tf_removed"]
    return without.select(*names).unionByName(joined.select(*names))


def sanitise(docs: DataFrame, text_col: str = "text", caution: float = CAUTION) -> DataFrame:
    """docs with pii_spans and clean_text: each span its kind in brackets, terms to be removed without any."""
    found = find_pii(docs, text_col, caution)
    name = lambda s: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"] + 1)
    label = lambda s: F.when((s["kind"] == 4) & F.array_contains("__tf_removed", F.lower(s["value"])), "").otherwise(name(s))
    text, spans = F.col("__tf_text"), F.col("pii_spans")

    def join(parts: Column, between: Column) -> Column:
        # what overlaps an earlier span has no label of its own
        pieces = F.transform(between, lambda g: F.when(g["span"]["start"] >= g["from"], F.concat(cut(parts, g["from"], g["to"]), label(g["span"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(parts, farthest(spans), F.char_length(text)))

    done = let(chunks(text), lambda parts: let(gaps(spans), lambda between: join(parts, between)))
    return found.withColumn("clean_text", F.when(F.size("pii_spans") > 0, done).otherwise(text)).drop("__tf_text", "__tf_spans", "__tf_removed")


def listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("__tf_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(listed(F.col("__tf_spans")), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}
#: The spans of the patterns need offsets of matches, which DuckDB doesn't give; tested against brute force.
ORACLE_SQL: dict[str, str] = {}
