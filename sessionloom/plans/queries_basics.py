"""Queries on loading, sequences and co-visitation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.constants import CLICK_ANCHORS, TYPE_WEIGHTS
from sessionloom.operators import covisitation as cv
from sessionloom.operators import sessions
from sessionloom.plans import inputs, sql
from sessionloom.plans.registry import query
from sessionloom.plans.sql import EV, KNOWN, OL, TEST, with_
from sessionloom.sources import interactions, tables

#: The times between which a click pair gains weight: a parameter of the rule.
ANCHORS = (1704067200, 1706659200)
WEIGHTS = {0: 1.0, 1: 5.0, 2: 2.0}


scratch = tables.scratch_folder


# Sources and sinks -----------------------------------------------------------

@query("io_load_interactions", with_(EV, body="SELECT * FROM ev"), longs="session aid ts type event_id")
def io_load(spark, d):
    return inputs.events(spark, d)


@query("io_load_segments", with_(EV, KNOWN, TEST, body=f"SELECT * FROM ev"), longs="session aid ts type event_id")
def io_segments(spark, d):
    """Written train and test parts, read back as one frame with the schema enforced."""
    ev, path = inputs.events(spark, d), scratch(spark, "segments")
    tables.write_table(ev.filter(F.col("ts") < inputs.dates(spark, d).test_from), f"{path}/train")
    tables.write_table(ev.filter(F.col("ts") >= inputs.dates(spark, d).test_from), f"{path}/test")
    return interactions.read_interactions(spark, [f"{path}/train", f"{path}/test"])


@query("io_encode_event_type", """
  SELECT event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'signup' THEN 1
         WHEN 'purchase' THEN 2 ELSE -1 END AS type, count(*) AS n FROM events GROUP BY 1, 2""",
       longs="type n", texts="event_type")
def io_encode(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet")
    code = F.coalesce(interactions.encode_type(F.col("event_type"), interactions.STREAM_LABELS), F.lit(-1))
    return raw.groupBy("event_type", code.alias("type")).agg(F.count("*").alias("n"))


@query("io_ranked_neighbour_lists",
       with_(EV, KNOWN, *sql.matrix("m", "known", "cart_orders", 15, weights=WEIGHTS), body="""
  SELECT aid_x, string_agg(CAST(aid_y AS VARCHAR), ' ' ORDER BY rank) AS aids FROM m GROUP BY 1"""),
       longs="aid_x", texts="aids")
def io_ranked_lists(spark, d):
    return tables.ranked_lists(cv.covisitation(inputs.known(spark, d), cv.cart_orders_rule(WEIGHTS), 15))


@query("io_session_event_lists", with_(EV, body="""
  SELECT session, (pos - 1) // 1000 AS chunk, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY pos) AS aids,
         string_agg(CAST(type AS VARCHAR), ' ' ORDER BY pos) AS types
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS pos FROM ev) GROUP BY 1, 2"""),
       longs="session chunk", texts="aids types")
def io_lists(spark, d):
    return sessions.event_chunks(inputs.events(spark, d), 1000)


@query("io_write_read_matrix",
       with_(EV, KNOWN, *sql.matrix("m", "known", "buy_to_buy", 15), body="SELECT * FROM m"),
       longs="aid_x aid_y rank", doubles="wgt")
def io_write(spark, d):
    built = cv.covisitation(inputs.known(spark, d), cv.buy_to_buy_rule(), 15)
    return tables.write_table(built, scratch(spark, "matrix"))


@query("io_reuse_if_present", with_(EV, body="SELECT aid, count(*) AS n FROM ev GROUP BY 1"), longs="aid n")
def io_reuse(spark, d):
    """The second call must not build: its builder would give an empty table."""
    counts = inputs.events(spark, d).groupBy("aid").agg(F.count("*").alias("n"))
    path = scratch(spark, "counts")
    tables.reuse_or_build(spark, path, lambda: counts)
    return tables.reuse_or_build(spark, path, lambda: counts.filter("false"))


@query("io_reuse_knows_its_input", with_(EV, body="""
  SELECT 'first' AS build, aid, count(*) AS n FROM ev GROUP BY 2
  UNION ALL SELECT 'same', aid, count(*) FROM ev GROUP BY 2
  UNION ALL SELECT 'changed', aid, count(*) FROM ev WHERE type = 0 GROUP BY 2"""), longs="aid n", texts="build")
def io_reuse_by_input(spark, d):
    """The same input reuses the table, though its builder would give an empty one; another input builds anew."""
    ev, path = inputs.events(spark, d), scratch(spark, "stamped")

    def counts(events):
        return events.groupBy("aid").agg(F.count("*").alias("n"))

    some, stamp = ev.filter("type = 0"), tables.input_stamp(ev)
    kept = [tables.cut_lineage(tables.reuse_or_build(spark, path, build, stamp=now)) for build, now in (
        (lambda: counts(ev), stamp), (lambda: counts(ev).filter("false"), tables.input_stamp(ev.repartition(3))), (lambda: counts(some), tables.input_stamp(some)))]
    named = [k.withColumn("build", F.lit(n)) for k, n in zip(kept, ("first", "same", "changed"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("io_first_sessions", with_(EV, body="""
  SELECT * FROM ev WHERE session IN (SELECT DISTINCT session FROM ev ORDER BY session LIMIT 20)"""),
       longs="session aid ts type event_id")
def io_first(spark, d):
    return tables.first_sessions(inputs.events(spark, d), 20)


# Sequences -------------------------------------------------------------------

@query("pre_real_sessions", with_(EV, body="""
  SELECT session, aid, ts, type, event_id, num_events, day, hour,
         sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id
                                                           ROWS UNBOUNDED PRECEDING) AS rs
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS gap,
               count(*) OVER (PARTITION BY session) AS num_events,
               dayofmonth(make_timestamp(ts * 1000000)) AS day, hour(make_timestamp(ts * 1000000)) AS hour
        FROM ev)"""), longs="session aid ts type event_id num_events day hour rs")
def pre_real_sessions(spark, d):
    return sessions.real_sessions(inputs.events(spark, d))


@query("pre_calendar", with_(EV, body="""
  SELECT event_id, isodow(make_timestamp(ts * 1000000)) - 1 AS weekday, hour(make_timestamp(ts * 1000000)) AS hour,
         dayofmonth(make_timestamp(ts * 1000000)) AS day FROM ev"""), longs="event_id weekday hour day")
def pre_calendar(spark, d):
    return sessions.calendar(inputs.events(spark, d)).select("event_id", "weekday", "hour", "day")


@query("pre_rebased_time", with_(EV, body=f"""
  SELECT event_id, ts - (SELECT min(ts) FROM ev) AS ts, {sql.span('ev')} AS span_days FROM ev"""),
       longs="event_id ts", doubles="span_days")
def pre_rebased(spark, d):
    return sessions.rebased(inputs.events(spark, d)).select("event_id", "ts", "span_days")


@query("pre_list_to_rows", with_(EV, sql.LABELS, body="""
  SELECT session, type, unnest(range(1, len(ground_truth) + 1)) AS rank, unnest(ground_truth) AS aid FROM truth"""),
       longs="session rank aid", texts="type")
def pre_list_to_rows(spark, d):
    return sessions.list_to_rows(inputs.labels(spark, d), "ground_truth")


@query("pre_lists_to_rows", with_(EV, body="""
  SELECT session, aid, type, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS rank FROM ev"""),
       longs="session aid type rank")
def pre_lists_to_rows(spark, d):
    """Parallel lists of each session back to rows, in lock-step."""
    lists = sessions.event_chunks(inputs.events(spark, d), 40).withColumnsRenamed({"aids": "aid", "types": "type"})
    rows = sessions.lists_to_rows(lists, ["aid", "type"])
    return rows.select("session", "aid", "type", (F.col("chunk") * 40 + F.col("rank")).alias("rank"))


NEXT = """nxt AS (
  SELECT * FROM (SELECT session, ts, event_id, aid,
                        lead(aid) OVER (PARTITION BY session ORDER BY ts, event_id) AS aid_next FROM {src})
  WHERE aid_next IS NOT NULL)"""


@query("pre_next_item_pairs", with_(EV, NEXT.format(src="ev"), body="SELECT * FROM nxt"),
       longs="session ts event_id aid aid_next")
def pre_next(spark, d):
    return sessions.next_items(inputs.events(spark, d))


@query("pre_next_item_pairs_order_lines", with_(OL, NEXT.format(src="ol"), body="""
  SELECT aid, aid_next, count(*) AS n FROM nxt GROUP BY 1, 2"""), longs="aid aid_next n")
def pre_next_order_lines(spark, d):
    return sessions.next_items(inputs.order_lines(spark, d)).groupBy("aid", "aid_next").agg(F.count("*").alias("n"))


@query("pre_tail_holdout", with_(EV, NEXT.format(src="ev"), body="""
  SELECT event_id, aid, aid_next,
         CASE WHEN row_number() OVER (ORDER BY ts DESC, event_id) <= 1000 THEN 1 ELSE 0 END AS is_valid FROM nxt"""),
       longs="event_id aid aid_next is_valid")
def pre_holdout(spark, d):
    held = sessions.tail_holdout(sessions.next_items(inputs.events(spark, d)), 1000)
    return held.select("event_id", "aid", "aid_next", "is_valid")


@query("pre_item_counts", with_(EV, body="SELECT session, aid, count(*) AS cc, 1 AS one FROM ev GROUP BY 1, 2"),
       longs="session aid cc one")
def pre_counts(spark, d):
    ev = inputs.events(spark, d)
    ones = sessions.item_counts(ev, ones=True).withColumnRenamed("cc", "one")
    return sessions.item_counts(ev).join(ones, ["session", "aid"])


@query("pre_id_profile", with_(EV, body="""
  SELECT 'aid' AS id, min(aid) AS min_id, max(aid) AS max_id, count(DISTINCT aid) AS n_ids FROM ev
  UNION ALL SELECT 'session', min(session), max(session), count(DISTINCT session) FROM ev"""),
       longs="min_id max_id n_ids", texts="id")
def pre_profile(spark, d):
    ev = inputs.events(spark, d)
    parts = [sessions.id_profile(ev, c).withColumn("id", F.lit(c)) for c in ("aid", "session")]
    return parts[0].unionByName(parts[1])


@query("pre_offset_ids", with_(EV, body="""
  SELECT session - (SELECT min(session) FROM ev) AS session, aid - (SELECT min(aid) FROM ev) AS aid, count(*) AS cc
  FROM ev GROUP BY 1, 2"""), longs="session aid cc")
def pre_offset(spark, d):
    return sessions.offset_ids(sessions.item_counts(inputs.events(spark, d)))


@query("pre_compact_ids", with_(OL, body="""
  SELECT aid, row_number() OVER (ORDER BY aid) - 1 AS compact_id FROM (SELECT DISTINCT aid FROM ol)"""),
       longs="aid compact_id")
def pre_compact(spark, d):
    return sessions.compact_ids(inputs.order_lines(spark, d))


# Co-visitation ---------------------------------------------------------------

@query("cv_session_tail", with_(EV, body="""
  SELECT * FROM (SELECT session, aid, ts, type, event_id,
                        row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS tail_pos FROM ev)
  WHERE tail_pos <= 30"""), longs="session aid ts type event_id tail_pos")
def cv_tail(spark, d):
    return cv.session_tail(inputs.events(spark, d))


def _pairs_query(name: str, rule: str) -> None:
    @query(name, with_(EV, KNOWN, *sql.matrix("m", "known", rule, 80, ANCHORS, WEIGHTS),
                       body="SELECT session, aid_x, aid_y, x_ts, y_ts, y_type FROM m_pairs"),
           longs="session aid_x aid_y x_ts y_ts y_type")
    def run(spark, d):
        return cv.session_pairs(inputs.known(spark, d), cv.RULES[rule]())


_pairs_query("cv_session_pairs_day", "clicks")
_pairs_query("cv_session_pairs_buys_week", "buy_to_buy")


def _matrix_query(name: str, source: str, cte: str, rule: str, top: int, make) -> None:
    ctes = (EV, KNOWN) if source == "known" else (cte,)

    @query(name, with_(*ctes, *sql.matrix("m", source, rule, top, ANCHORS, WEIGHTS), body="SELECT * FROM m"),
           longs="aid_x aid_y rank", doubles="wgt")
    def run(spark, d):
        frame = inputs.known(spark, d) if source == "known" else inputs.order_lines(spark, d)
        return cv.covisitation(frame, make(), top)


_matrix_query("cv_clicks_matrix", "known", EV, "clicks", 20, lambda: cv.clicks_rule(ANCHORS))
_matrix_query("cv_cart_orders_matrix", "known", EV, "cart_orders", 15, lambda: cv.cart_orders_rule(WEIGHTS))
_matrix_query("cv_buy_to_buy_matrix", "known", EV, "buy_to_buy", 15, cv.buy_to_buy_rule)
_matrix_query("cv_clicks_matrix_order_lines", "ol", OL, "clicks", 20, lambda: cv.clicks_rule(ANCHORS))
_matrix_query("cv_cart_orders_matrix_order_lines", "ol", OL, "cart_orders", 15, lambda: cv.cart_orders_rule(WEIGHTS))
_matrix_query("cv_buy_to_buy_matrix_order_lines", "ol", OL, "buy_to_buy", 15, cv.buy_to_buy_rule)


@query("cv_pair_weights", with_(EV, KNOWN, *sql.matrix("m", "known", "cart_orders", 80, weights=WEIGHTS),
                                body="SELECT * FROM m_wgt"), longs="aid_x aid_y", doubles="wgt")
def cv_weights(spark, d):
    rule = cv.cart_orders_rule(WEIGHTS)
    return cv.pair_weights(cv.session_pairs(inputs.known(spark, d), rule), rule)


RULES = ("clicks", "cart_orders", "buy_to_buy")


@query("cv_rules_by_name",
       with_(EV, KNOWN, *[c for r in RULES for c in sql.matrix(r, "known", r, 80, CLICK_ANCHORS, TYPE_WEIGHTS)],
             body=" UNION ALL ".join(f"SELECT '{r}' AS rule, aid_x, count(*) AS n, sum(wgt) AS total FROM {r} GROUP BY 2" for r in RULES)),
       longs="aid_x n", doubles="total", texts="rule")
def cv_by_name(spark, d):
    """All rules by their names, with the published parameters."""
    parts = [
        cv.covisitation(inputs.known(spark, d), rule, 80).groupBy("aid_x").agg(
            F.lit(rule).alias("rule"), F.count("*").alias("n"), F.sum("wgt").alias("total"))
        for rule in RULES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
