"""Personal data: patterns, and terms that disclose what the patterns found. Native expressions only.

The patterns give the protected entities. What a term t tells about an entity e is their
pointwise mutual information, of at most the information content of e:

    PMI(t; e) = ln(N n(t, e) / (n(t) n(e))),   IC(e) = ln(N / n(e)),   PMI / IC = 1 + ln(n(t, e) / n(t)) / IC(e)

with counts over all documents; n(t, e) counts those that hold both. A term that reaches the
threshold with an entity of enough different contexts is generalised (numbers to their shape) or
removed wherever it stands, in any document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import text_or_empty
from sessionloom.operators import ordering
from sessionloom.sources.tables import cut_lineage

#: Kinds in order, with their patterns. Possessive repeats and the look at the
#: character before a match give the same matches in linear time and without deep recursion.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{3,}"
#: Rows of a side that may be broadcast.
SMALL = 100_000
SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str, offset: Column | int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches of a pattern (those that ``keep`` accepts) with their places in code points: what lies between them is measured."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(offset).cast("int").alias("at") if isinstance(offset, int) else offset.cast("int").alias("at"),
                     F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        grown = F.array_append(acc["out"], span)
        return F.struct(end.alias("at"), (grown if keep is None else F.when(keep(pair["hit"]), grown).otherwise(acc["out"])).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits' Luhn sum divides by 10."""
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z"),
    "card": lambda v: F.char_length(_digits(v)).between(13, 19) & _luhn(v),
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}
#: A text without such a match has none of the kind: a cheap look before the dear one.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}


def _spans(text: Column, kind: str, pattern: str) -> Column:
    hit = F.filter(located(text, pattern), lambda s: VALID[kind](s["value"]))
    return F.when(text.rlike(HINT[kind]), hit).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and one span array per kind; matches that fail their test are dropped."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    text = F.col("text")
    for kind, pattern in KINDS.items():
        d = d.withColumn(kind, _spans(text, kind, pattern))
    return d


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _contexts(found: DataFrame, words: int, reach: int) -> DataFrame:
    """key, entity, and context of each of its places: a hash of the terms up to ``words`` terms from it."""
    text = F.col("text")

    def entities(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(kind + ":"), F.lower(s["value"])).alias("entity")))

    every = F.concat(*map(entities, KINDS))
    base = F.concat(*[F.col(k) for k in KINDS])

    def around(s: Column) -> Column:
        low = F.greatest(s["start"] - reach, F.lit(0))
        before = located(F.substring(text, low + 1, s["start"] - low), TERM, low)
        after = located(F.substring(text, s["end"] + 1, F.lit(reach)), TERM, s["end"])
        # A term at the edge of the stretch may be cut.
        before = F.filter(before, lambda t: (t["start"] > low) | (low == 0))
        after = F.filter(after, lambda t: (t["end"] < s["end"] + reach))
        size = F.size(before)
        near = F.concat(F.slice(before, F.greatest(size - words + 1, F.lit(1)), F.lit(words)), F.slice(after, 1, words))
        return F.filter(near, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    occurrences = found.filter(F.size(base) > 0).select(
        "key", F.explode(F.transform(every, lambda s: F.struct(s["entity"].alias("entity"), around(s).alias("terms")))).alias("o"))
    context = F.xxhash64(F.transform("o.terms", lambda t: F.lower(t["value"])))
    return occurrences.select("key", F.col("o.entity").alias("entity"), context.alias("context")).distinct()


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _blanked() -> Column:
    """``text`` with spaces in place of the base spans: all other places stay."""
    text, spans = F.col("text"), F.array_sort(F.concat(*[F.col(k) for k in KINDS]))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        end = F.greatest(s["end"], acc["at"])
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), end - start))
        return F.struct(end.alias("at"), put.alias("out"))

    blank = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(blank)


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed side, hinted for broadcast if counted to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def disclosing_terms(docs: DataFrame, found: DataFrame, places: DataFrame, threshold: float, support: int) -> DataFrame:
    """(entity, term, disclosure) of the terms whose PMI reaches ``threshold`` times the entity's IC.

    ``support``: different contexts of the entity, in documents with the term, that must be there,
    so that copies of one document prove nothing. Counts are over all documents.
    """
    known = places.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    held = cut_lineage(places.join(known.select("entity"), "entity", "left_semi"))
    keys = _small(cut_lineage(held.select("key").distinct()))
    texts = found.join(keys, "key", "left_semi").select("key", _terms(_blanked()).alias("terms")).dropDuplicates(["key"])
    pairs = held.join(texts, "key").select("entity", "key", "context", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.count_distinct("key").alias("n_te"), F.count_distinct("context").alias("contexts")).filter(F.col("contexts") >= support)
    pairs = cut_lineage(pairs)
    entities = held.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    # Counted before they are joined: one row per term meets the pairs, however many documents hold it.
    terms = docs.select(F.explode(_terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("n")).first()["n"]
    told = pairs.join(entities, "entity").join(terms, "term")
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    return told.withColumn("disclosure", 1 + F.log(F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))) / content).filter(
        (content > 0) & (F.col("disclosure") >= threshold)).select("entity", "term", "disclosure")


def find(docs: DataFrame, threshold: float = 0.9, support: int = 3, words: int = 8, reach: int = 120) -> tuple[DataFrame, DataFrame]:
    """(found, added): base spans per row of ``docs`` with a key, and added term spans per key.

    Rows equal in doc_id and text share a key and count as one document in co-occurrence. ``words``
    and ``reach`` say what a context is; terms are counted and added over whole documents.
    """
    found = base_spans(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    places = cut_lineage(_contexts(found, words, reach))
    told = cut_lineage(disclosing_terms(docs, found, places, threshold, support).select("term").distinct())
    if told.isEmpty():
        return found, found.sparkSession.createDataFrame([], f"key long, term {SPAN}")
    own = F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())
    each = docs.select(own.alias("key"), F.explode(_terms(text_or_empty())).alias("term"))
    small = told.limit(SMALL + 1).count() <= SMALL
    hits = each.join(F.broadcast(told), "term") if small else ordering.spread_join(each, told, ["term"], salt_by=["key"])
    hits = _small(cut_lineage(hits.groupBy("key").agg(F.collect_set("term").alias("terms"))))
    spans = located(_blanked(), TERM, keep=lambda t: F.array_contains("terms", F.lower(t)))
    added = found.join(hits, "key").select("key", spans.alias("term")).filter(F.size("term") > 0).dropDuplicates(["key"])
    return found, cut_lineage(added)


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of every row of ``docs``.

    spans: kind:start:end in code points, kinds in the order of KINDS, then ``term``, joined by
    commas. Null and empty texts have none; null doc_ids and repeated rows are kept; other
    columns are ignored; an empty table gives an empty result.
    """
    found, added = find(docs, **options)
    base = F.array_join(F.concat(*[_written(k, F.col(k)) for k in KINDS]), ",")
    flat = found.select("doc_id", "key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"))
    own = added.select("key", F.array_join(_written("term", F.col("term")), ",").alias("terms"), F.size("term").cast("long").alias("n_term"))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "terms")
    return flat.join(own, "key", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.coalesce("n_term", F.lit(0)).alias("n_term"),
        F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def sanitise(docs: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """``docs`` with the found spans of ``text`` replaced: [EMAIL] and so on, numbers among added
    terms by their shape (0 for each digit), other added terms by [TERM]. Rows stay, in number
    and in their other columns; a null text stays null."""
    columns = list(columns or docs.columns)
    found, added = find(docs, **options)
    key = F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())
    whole = docs.select(F.struct(*columns).alias("row"), "doc_id", "text").withColumn("key", key)
    text = text_or_empty()
    for kind, pattern in KINDS.items():
        whole = whole.withColumn(kind, _spans(text, kind, pattern))
    # Few rows have personal data or a disclosing term: the others pass as they are.
    whole = whole.join(_small(added), "key", "left")
    some = (F.greatest(*[F.size(k) for k in KINDS]) > 0) | F.col("term").isNotNull()
    rest = whole.filter(~some).select("row.*")
    hit = whole.filter(some)

    def masked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))

    term = F.transform(F.coalesce("term", F.array().cast(SPAN)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["value"].rlike(r"\A[0-9]+\z"), F.regexp_replace(s["value"], "[0-9]", "0")).otherwise("[TERM]").alias("put")))
    every = F.array_sort(F.concat(*map(masked, KINDS), term))
    t = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]  # a span inside or across the one before only moves the end
        grown = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), s["put"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.char_length(t))))
    return rest.unionByName(hit.select("row.*", clean.alias("_clean")).select(
        *[F.col("_clean").alias(c) if c == "text" else F.col(c) for c in columns]))
