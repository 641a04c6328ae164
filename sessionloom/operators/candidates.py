"""Candidate items per session, from its history and from neighbour tables.

A neighbour table has columns (aid, neighbor, rank). Sessions with fewer than C distinct
items take their history, then the neighbours with most votes, then popular items. Sessions
with at least C distinct items rank what they saw by recency and kind of event.

All neighbour tables of an event are looked up in one join, for both kinds of session. Short
sessions have fewer than C items, so their votes are bounded; those of long sessions are
aggregated before they are shuffled, and the top-C window cuts them map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.constants import HOT_ROWS, TYPE_WEIGHTS
from sessionloom.operators import ordering


@dataclass(frozen=True)
class Source:
    """Ranks ``first..last`` of a neighbour table vote, for all history items or only carts and orders."""

    table: str
    last: int
    first: int = 1
    buys_only: bool = False


@dataclass(frozen=True)
class CandidateSpec:
    """What one event type suggests. ``short`` and ``long`` list the voting tables by history length."""

    event: str
    candidates: int
    alpha: float
    popular_type: int
    short: tuple[Source, ...]
    long: tuple[Source, ...] = ()
    session_recs_short: int = 0
    session_recs_long: int = 0
    share: float = 1.0
    long_vote: float = 0.1
    type_weights: Mapping[int, float] = field(default_factory=lambda: dict(TYPE_WEIGHTS))

    def only(self, *tables: str) -> CandidateSpec:
        """The same suggestion without the sources whose table is not at hand."""
        def keep(sources):
            return tuple(s for s in sources if s.table in tables)

        recs = "session_recs" in tables
        return replace(
            self, short=keep(self.short), long=keep(self.long),
            session_recs_short=self.session_recs_short if recs else 0,
            session_recs_long=self.session_recs_long if recs else 0)


def clicks_spec(candidates: int = 60, click_limit: int = 60, buy_limit: int = 10, **kw) -> CandidateSpec:
    return CandidateSpec(
        event="clicks", candidates=candidates, alpha=0.1, popular_type=0,
        short=(Source("clicks", click_limit), Source("cart_orders", buy_limit), Source("word2vec", 5)), **kw)


def _cart_sources(click_limit: int, buy_limit: int) -> tuple[Source, ...]:
    return (
        Source("clicks", click_limit), Source("cart_orders", buy_limit), Source("buy_to_buy", buy_limit),
        Source("buy_to_buy", buy_limit, buys_only=True), Source("cart_orders", buy_limit, buys_only=True),
        Source("word2vec", 10), Source("bpr", 3),
    )


def _bought_sources(buy_limit: int) -> tuple[Source, ...]:
    return (Source("buy_to_buy", buy_limit, buys_only=True), Source("cart_orders", buy_limit, buys_only=True),
            Source("word2vec", 10, buys_only=True))


def carts_spec(candidates: int = 60, click_limit: int = 60, buy_limit: int = 10, **kw) -> CandidateSpec:
    return CandidateSpec(
        event="carts", candidates=candidates, alpha=0.5, popular_type=1,
        short=_cart_sources(click_limit, buy_limit), long=(*_bought_sources(buy_limit), Source("bpr", 3)),
        session_recs_short=3, session_recs_long=3, **kw)


def orders_spec(candidates: int = 60, click_limit: int = 60, buy_limit: int = 10, **kw) -> CandidateSpec:
    """As carts for short histories; popular items come from carts, too."""
    return CandidateSpec(
        event="orders", candidates=candidates, alpha=0.5, popular_type=1,
        short=_cart_sources(click_limit, buy_limit), long=_bought_sources(buy_limit),
        session_recs_short=3, **kw)


SPECS = {"clicks": clicks_spec, "carts": carts_spec, "orders": orders_spec, "buys": orders_spec}


def matrix_neighbours(matrix: DataFrame) -> DataFrame:
    """A co-visitation matrix as a neighbour table."""
    return matrix.select(F.col("aid_x").alias("aid"), F.col("aid_y").alias("neighbor"), "rank")


def history(events: DataFrame) -> DataFrame:
    """Distinct items of each session with their newest event, and their newest cart or order."""
    moment = F.struct("ts", "event_id")
    return events.groupBy("session", "aid").agg(
        F.count("*").alias("n"), F.max(moment).alias("seen"), F.min(moment).alias("opened"),
        F.max(F.when(F.col("type").isin(1, 2), moment)).alias("bought"))


def history_ranked(events: DataFrame, buys_only: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct items of each session, most recent first, with their rank."""
    if buys_only:
        events = events.filter(F.col("type").isin(1, 2))
    late = history(events).select("session", "aid", "seen")
    return ordering.positions(late, ["session"], [F.col("seen").desc()], "rank", hot_rows).select("session", "aid", "rank")


def session_sizes(hist: DataFrame) -> DataFrame:
    """Events and distinct items of each session, from its history."""
    return hist.groupBy("session").agg(F.sum("n").alias("n"), F.count("*").alias("n_hist"))


def recency_score(events: DataFrame, alpha: float, type_weights: Mapping[int, float] = TYPE_WEIGHTS,
                  hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Score per (session, aid): later events and heavier event types count more.

    The i-th of n events (from 0) weighs 2^(alpha + i (1 - alpha) / (n - 1)) - 1 times its
    type's weight. ``opened`` is the item's first event. Sessions missing in ``sizes`` are
    left out.
    """
    sizes = ordering.key_sizes(events, ["session"]) if sizes is None else sizes
    counted = sizes.select("session", F.col("n").alias("n_events"))
    sized = ordering.spread_join(events, counted, ["session"], salt_by=["event_id"], hot_rows=hot_rows, sizes=sizes)
    placed = ordering.positions(sized, ["session"], hot_rows=hot_rows, sizes=sizes)
    step = F.coalesce(F.try_divide(F.lit(1.0 - alpha), (F.col("n_events") - 1).cast("double")), F.lit(0.0))
    weights = F.create_map(*[F.lit(x) for t, w in sorted(type_weights.items()) for x in (t, float(w))])
    score = (F.pow(F.lit(2.0), F.lit(alpha) + (F.col("pos") - 1) * step) - 1.0) * F.element_at(weights, F.col("type"))
    return placed.groupBy("session", "aid").agg(
        F.sum(score).alias("score"), F.min(F.struct("ts", "event_id")).alias("opened"))


def popular_items(events: DataFrame, k: int) -> DataFrame:
    """The k items with most events of each type; ties go to the smaller item."""
    best = W.partitionBy("type").orderBy(F.col("n").desc(), F.col("aid"))
    counts = events.groupBy("type", "aid").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def neighbour_lookup(seeds: DataFrame, table: DataFrame, k: int, first: int = 1,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """The neighbours ranked first..k of every seed item; items without neighbours are skipped."""
    chosen = table.filter(F.col("rank").between(first, k)).select("aid", "neighbor", "rank")
    return ordering.spread_join(seeds.select("session", "aid"), chosen, ["aid"], hot_rows=hot_rows)


def unseen_session_recs(session_recs: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The first k recommended items of each session that are not in its history."""
    fresh = session_recs.join(seen.select("session", "aid"), ["session", "aid"], "left_anti")
    best = W.partitionBy("session").orderBy("rank", "aid")
    return fresh.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "session", "aid", "rank")


# A vote's place in the order of insertion: source number, then recency of the seed item
# (newest first), then the neighbour's rank. Ties in votes go to the earliest place.
def _place(source: Column, ts: Column, event_id: Column, rank: Column) -> Column:
    return F.struct(source.cast("int").alias("source"), ts.cast("long").alias("ts"),
                    event_id.cast("long").alias("id"), rank.cast("int").alias("rank"))


def neighbour_lists(tables: Mapping[str, DataFrame], reach: Mapping[str, int]) -> DataFrame:
    """One row per item with one array column per table: its first ``reach`` neighbours in rank order.

    Ranks run from 1 without gaps, so a neighbour's place in the array is its rank.
    """
    rows = reduce(DataFrame.unionByName, [
        tables[n].filter(F.col("rank") <= k).select(
            F.col("aid").cast("long").alias("aid"), F.col("neighbor").cast("long").alias("neighbor"), "rank",
            F.lit(n).alias("table"))
        for n, k in reach.items()])
    ranked = {n: F.sort_array(F.collect_list(F.when(F.col("table") == n, F.struct("rank", "neighbor")))) for n in reach}
    return rows.groupBy("aid").agg(*[
        F.transform(r, lambda x: x["neighbor"]).alias(n) for n, r in ranked.items()])


def _reach(*lists: Sequence[Source]) -> dict[str, int]:
    out: dict[str, int] = {}
    for s in (s for each in lists for s in each):
        out[s.table] = max(out.get(s.table, 0), s.last)
    return out


_PLACE = "struct<source:int,ts:bigint,id:bigint,rank:int>"
_SEEN = "struct<ts:bigint,event_id:bigint>"
_MARK = f"struct<aid:bigint,vote:bigint,place:{_PLACE},seen:{_SEEN}>"


def _mark(aid: Column, vote: int, place: Column, seen: Column) -> Column:
    return F.struct(aid.cast("long").alias("aid"), F.lit(vote).cast("long").alias("vote"),
                    place.cast(_PLACE).alias("place"), seen.cast(_SEEN).alias("seen")).cast(_MARK)


def _vote_marks(sources: Sequence[Source]) -> Column:
    """The votes of one seed item, from the neighbour arrays of its row, as an array of marks."""
    none = F.array().cast(f"array<{_MARK}>")

    def votes_of(number: int, s: Source) -> Column:
        moment = F.col("bought" if s.buys_only else "seen")

        def vote(x: Column, k: Column) -> Column:
            return _mark(x, 1, _place(F.lit(number), -moment["ts"], -moment["event_id"], k + s.first), F.lit(None))

        listed = F.transform(F.slice(F.col(s.table), s.first, s.last - s.first + 1), vote)
        return F.coalesce(F.when(moment.isNotNull(), listed), none)

    return F.concat(none, *[votes_of(i, s) for i, s in enumerate(sources, start=1)])


def source_votes(seeds: DataFrame, tables: Mapping[str, DataFrame], sources: Sequence[Source],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row (session, aid, place) per vote of the sources for the neighbours of a history's items."""
    lists = neighbour_lists(tables, _reach(sources))
    met = ordering.spread_join(seeds.select("session", "aid", "seen", "bought"), lists, ["aid"], hot_rows=hot_rows)
    return met.select("session", F.inline(_vote_marks(sources))).select("session", "aid", "place")


def vote_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("session", "aid").agg(F.count("*").alias("votes"), F.min("place").alias("place"))


#: Votes and history items that a task holds as rows.
TASK_MARKS = 500_000


def _vote_tasks(events: DataFrame, spec: CandidateSpec) -> int:
    """Partitions that hold about TASK_MARKS marks if every event is another item with full neighbour lists."""
    voted = max(sum(s.last - s.first + 1 for s in sources) for sources in (spec.short, spec.long))
    marks = 1 + voted + max(spec.session_recs_short, spec.session_recs_long)
    return max(1, -(-events.count() * marks // TASK_MARKS))


def _recs_lists(session_recs: DataFrame, hist: DataFrame, spec: CandidateSpec) -> DataFrame:
    """session, is_long and the array of its first unseen recommended items."""
    kinds = hist.groupBy("session").agg(F.bool_or("is_long").alias("is_long"))
    most = max(spec.session_recs_short, spec.session_recs_long)
    recs = unseen_session_recs(session_recs, hist, most).join(kinds, "session")
    limit = F.when(F.col("is_long"), spec.session_recs_long).otherwise(spec.session_recs_short)
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.col("aid").cast("long").alias("aid"))))
    return recs.filter(F.col("rank") <= limit).groupBy("session", "is_long").agg(
        F.transform(ranked, lambda x: x["aid"]).alias("recs"))


def suggest(events: DataFrame, tables: Mapping[str, DataFrame], spec: CandidateSpec,
            session_recs: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidates (session, aid, rank, rec) of one event type for every session of ``events``.

    A history item travels to its session with its neighbour lists as arrays of numbers;
    votes become rows only behind that shuffle, where they are counted at once; its partitions are as
    many as the votes need, since arrays in bytes do not tell how many rows they become. A short
    session is one group there; a long one is cut by seed item and its counts are merged.
    """
    c = spec.candidates
    hist = history(events)
    sizes = session_sizes(hist)
    kinds = sizes.select("session", F.col("n_hist").alias("n"), (F.col("n_hist") >= c).alias("is_long"))
    hist = ordering.spread_join(hist, kinds.drop("n"), ["session"], salt_by=["aid"], hot_rows=hot_rows, sizes=kinds)

    sent = hist.select("session", F.col("aid").cast("long").alias("aid"), F.col("seen").cast(_SEEN).alias("seen"),
                       F.col("bought").cast(_SEEN).alias("bought"), "is_long")
    reach = _reach(spec.short, spec.long)
    if reach:
        sent = ordering.spread_join(sent, neighbour_lists(tables, reach), ["aid"], "left", hot_rows=hot_rows)
    with_recs = session_recs is not None and (spec.session_recs_short or spec.session_recs_long)
    if with_recs:
        sent = sent.unionByName(_recs_lists(session_recs, hist, spec), allowMissingColumns=True)
    part = F.when(F.col("is_long"), F.pmod(F.xxhash64("aid"), F.lit(1024)).cast("int")).otherwise(0)
    sent = sent.withColumn("part", part).repartition(
        _vote_tasks(events, spec), "session", "part")

    nothing = F.array().cast(f"array<{_MARK}>")
    own = F.when(F.col("aid").isNotNull() & ~F.col("is_long"),
                 F.array(_mark(F.col("aid"), 0, F.lit(None), F.col("seen")))).otherwise(nothing)
    votes = F.when(F.col("is_long"), _vote_marks(spec.long)).otherwise(_vote_marks(spec.short))
    if with_recs:
        last = F.when(F.col("is_long"), len(spec.long) + 1).otherwise(len(spec.short) + 1)
        zero = F.lit(0)
        voted = F.transform("recs", lambda x, k: _mark(x, 1, _place(last, zero, zero, k + 1), F.lit(None)))
        votes = F.concat(votes, F.coalesce(voted, nothing))
    items = sent.select("session", "part", "is_long", F.inline(F.concat(own, votes))).groupBy(
        "session", "part", "aid").agg(
        F.sum("vote").alias("votes"), F.min("place").alias("place"), F.max("seen").alias("seen"),
        F.bool_or("is_long").alias("is_long"))

    popular = popular_items(events.filter(F.col("type") == spec.popular_type), c).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "aid"))), lambda p: p["aid"].cast("long"))
        .alias("p")).scalar()
    scored = recency_score(events, spec.alpha, spec.type_weights, hot_rows, sizes.filter(F.col("n_hist") >= c))
    return _short(items.filter(~F.col("is_long")), popular, spec).unionByName(
        _long(scored, items.filter(F.col("is_long")), spec))


def _short(items: DataFrame, popular: Column, spec: CandidateSpec) -> DataFrame:
    """History, then the best voted items outside it, then popular ones, up to C."""
    c = spec.candidates
    session = W.partitionBy("session", "part")
    is_hist = F.col("seen").isNotNull()
    voted = items.withColumns({
        "vote_rank": F.row_number().over(session.orderBy(F.col("votes").desc(), F.col("place"))),
        "top": F.max("votes").over(session),
        "n_hist": F.count("seen").over(session),
    }).filter(is_hist | ((F.col("votes") > 0) & (F.col("vote_rank") <= c)))
    in_order = session.orderBy(F.col("seen").desc_nulls_last(), F.col("vote_rank"))
    quota = F.greatest(F.lit(int(c * spec.share)), F.col("n_hist"))
    kept = voted.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= quota)
    rec = F.when(is_hist, 1.5).otherwise(F.try_divide(F.col("votes").cast("double"), F.col("top").cast("double")))
    ranked = F.sort_array(F.collect_list(F.struct("rank", "aid", rec.alias("rec"))))
    own = F.transform(ranked, lambda p: F.struct(p["aid"].alias("aid"), p["rec"].alias("rec")))
    lists = kept.groupBy("session", "part").agg(own.alias("own")).withColumn("popular", popular)
    missing = F.array_except("popular", F.transform("own", lambda p: p["aid"]))
    fill = F.transform(missing, lambda a: F.struct(a.alias("aid"), F.lit(0.0).alias("rec")))
    return lists.select("session", F.posexplode(F.slice(F.concat("own", fill), 1, c)).alias("p", "x")).select(
        "session", "x.aid", (F.col("p") + 1).alias("rank"), "x.rec")


def _long(scored: DataFrame, voted: DataFrame, spec: CandidateSpec) -> DataFrame:
    """The C best items by recency score and votes; rec is constant."""
    first = _place(F.lit(0), F.col("opened.ts"), F.col("opened.event_id"), F.lit(0))
    marks = scored.select("session", F.col("aid").cast("long").alias("aid"), "score",
                          F.lit(0).cast("long").alias("votes"), first.alias("place"))
    if spec.long or spec.session_recs_long:
        marks = marks.unionByName(voted.select("session", "aid", F.lit(0.0).alias("score"), "votes", "place"))
        marks = marks.groupBy("session", "aid").agg(
            F.sum("score").alias("score"), F.sum("votes").alias("votes"), F.min("place").alias("place"))
    total = F.round(F.col("score") + F.col("votes") * F.lit(spec.long_vote), 9)
    best = W.partitionBy("session").orderBy(total.desc(), F.col("place"))
    return marks.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= spec.candidates).select(
        "session", "aid", "rank", F.lit(1.5).alias("rec"))


def candidate_check(candidates: DataFrame, c: int) -> DataFrame:
    """One row: whether every session has exactly c candidates, and how many sessions fall short."""
    sizes = candidates.groupBy("session").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.bool_and(F.col("n") == c).alias("all_equal"),
        F.count("*").alias("sessions"),
        F.coalesce(F.sum((F.col("n") < c).cast("long")), F.lit(0)).alias("short_lists"))
