"""Queries on item, session and interaction features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES
from sessionloom.operators import interaction_features as xf
from sessionloom.operators import item_features as af
from sessionloom.operators import session_features as sf
from sessionloom.plans import inputs, sql
from sessionloom.plans.registry import query
from sessionloom.plans.sql import EV, KNOWN, TEST, with_

LW = f"lw AS (SELECT * FROM known WHERE ts >= {sql.TEST_FROM})"
DAYS = range(7)
TYPES = EVENT_TYPES.items()


def _basic(key: str, partner: str, src: str, out: str, times: float | None) -> list[str]:
    """CTEs up to ``out``: the columns that item and session features share, in SQL."""
    t = sql.span(src)
    cols = [f"count(*) / {t} AS {key}_{partner}_count", f"count(DISTINCT {partner}) / {t} AS {key}_{partner}_nunique"]
    cols += [f"{f}(type) AS {key}_type_{n}" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))]
    if times is not None:
        cols += [f"min(rel) AS {key}_ts_min", f"max(rel) AS {key}_ts_max", f"avg(rel) AS {key}_ts_mean",
                 f"coalesce(stddev_samp(rel), {times}) AS {key}_ts_std"]
    cols += [f"{f}({u}) AS {key}_{u}_{n}" for u in ("day", "hour") for n, f in (("mean", "avg"), ("max", "max"))]
    cols += [f"count(*) FILTER (day = {d}) / {t} AS {key}_inter_day_{d}" for d in DAYS]
    for e, code in TYPES:
        cols += [f"count(*) FILTER (type = {code}) / {t} AS {key}_{partner}_count_{e}",
                 f"count(DISTINCT {partner}) FILTER (type = {code}) / {t} AS {key}_{partner}_nunique_{e}"]
    if key == "session":
        cols.append(f"(max(rel) - min(rel)) / {t} AS session_length_ts")
        cols += [f"avg(CASE WHEN type = {code} THEN 1.0 ELSE 0.0 END) AS session_percent_count_{e}" for e, code in TYPES]
    marked = sql.marked(f"{out}_m", src)
    if key == "session":
        return [marked, f"{out} AS (SELECT session, {', '.join(cols)} FROM {out}_m GROUP BY 1)"]
    first = f"""{out}_first AS (
  SELECT f.aid, f.type, (SELECT count(*) FROM {src} s WHERE s.aid = f.aid AND s.type = f.type) AS n_first,
         (SELECT count(*) FROM {src} s WHERE s.aid = f.aid AND s.type = 0) AS n_clicks
  FROM (SELECT aid, type, row_number() OVER (PARTITION BY aid ORDER BY ts, event_id) AS r FROM {src}) f WHERE f.r = 1)"""
    shares = ["CAST(n_clicks AS DOUBLE) / n_first AS aid_percent_count_clicks"]
    shares += [f"CASE WHEN type = {code} THEN 1.0 / n_first ELSE 0 END AS aid_percent_count_{e}"
               for e, code in TYPES if e != "clicks"]
    return [marked, first, f"{out}_b AS (SELECT aid, {', '.join(cols)} FROM {out}_m GROUP BY 1)",
            f"{out} AS (SELECT b.*, {', '.join(shares)} FROM {out}_b b JOIN {out}_first USING (aid))"]


def _basic_names(key: str, partner: str, times: bool) -> list[str]:
    out = [f"{key}_{partner}_count", f"{key}_{partner}_nunique", *[f"{key}_type_{s}" for s in ("mean", "min", "max")]]
    out += [f"{key}_ts_{s}" for s in ("min", "max", "mean", "std")] if times else []
    out += [f"{key}_{u}_{s}" for u in ("day", "hour") for s in ("mean", "max")]
    out += [f"{key}_inter_day_{d}" for d in DAYS]
    out += [f"{key}_{partner}_{s}_{e}" for e in EVENT_TYPES for s in ("count", "nunique")]
    out += [f"{key}_percent_count_{e}" for e in EVENT_TYPES]
    return out + (["session_length_ts"] if key == "session" else [])


ITEM = _basic_names("aid", "session", False)
ITEM_LW = [f"LW_{c}" for c in _basic_names("aid", "session", True)]
SESSION = _basic_names("session", "aid", True)
ITEM_GAPS = [f"aid_ts_diff_{s}" for s in ("avg", "min", "max")]
SESSION_GAPS = [f"session_ts_diff_{s}" for s in ("avg", "std", "min", "max")]
_RENAMED = ", ".join(f"{c[3:]} AS {c}" for c in ITEM_LW)
ITEM_CTES = _basic("aid", "session", "known", "item", None)
LW_CTES = _basic("aid", "session", "lw", "recent", -1.0)
SESSION_CTES = _basic("session", "aid", "test", "sess", 0.0)


# Items -----------------------------------------------------------------------

@query("af_item_basic", with_(EV, KNOWN, *ITEM_CTES, body="SELECT * FROM item"), longs="aid", doubles=" ".join(ITEM))
def item_basic(spark, d):
    return af.item_basic(inputs.known(spark, d))


def _part(name: str, wanted: list[str]) -> None:
    @query(name, with_(EV, KNOWN, *ITEM_CTES, body="SELECT * FROM item"), longs="aid", doubles=" ".join(wanted))
    def run(spark, d):
        return af.item_basic(inputs.known(spark, d)).select("aid", *wanted)


_part("af_weekday_histogram", [f"aid_inter_day_{d}" for d in DAYS])
_part("af_type_share", [f"aid_percent_count_{e}" for e in EVENT_TYPES])
_part("af_per_type_sessions", [f"aid_session_{s}_{e}" for e in EVENT_TYPES for s in ("count", "nunique")])


@query("af_type_share_intended", with_(EV, KNOWN, body="SELECT aid, " + ", ".join(
    f"avg(CASE WHEN type = {c} THEN 1.0 ELSE 0.0 END) AS aid_percent_count_{e}" for e, c in TYPES)
    + " FROM known GROUP BY 1"), longs="aid", doubles=" ".join(f"aid_percent_count_{e}" for e in EVENT_TYPES))
def share_intended(spark, d):
    basic = af.item_basic(inputs.known(spark, d), intended_shares=True)
    return basic.select("aid", *[f"aid_percent_count_{e}" for e in EVENT_TYPES])


@query("af_item_last_week", with_(EV, KNOWN, LW, *LW_CTES, body=f"SELECT aid, {_RENAMED} FROM recent"),
       longs="aid", doubles=" ".join(ITEM_LW))
def item_last_week(spark, d):
    return af.item_last_week(inputs.known(spark, d).filter(F.col("ts") >= inputs.dates(spark, d).test_from))


@query("af_last_week_times", with_(EV, KNOWN, LW, body="""
  SELECT aid, avg(rel) AS aid_LW_ts_mean, coalesce(stddev_samp(rel), -1) AS aid_LW_ts_std, min(rel) AS aid_LW_ts_min,
         max(rel) AS aid_LW_ts_max FROM (SELECT aid, ts - (SELECT min(ts) FROM lw) AS rel FROM lw) GROUP BY 1"""),
       longs="aid aid_LW_ts_min aid_LW_ts_max", doubles="aid_LW_ts_mean aid_LW_ts_std")
def last_week_times(spark, d):
    return af.item_window_times(inputs.known(spark, d), inputs.dates(spark, d).test_from).na.fill(-1.0)


def _gaps_sql(src: str, prefix: str, with_std: bool) -> str:
    std = f"coalesce(gap / nullif(sd, 0), 0) AS {prefix}_ts_diff_std," if with_std else ""
    return f"""SELECT session, aid, event_id, coalesce(gap / mean, 0) AS {prefix}_ts_diff_avg, {std}
         coalesce(gap / nullif(lo, 0), 0) AS {prefix}_ts_diff_min, coalesce(gap / nullif(hi, 0), 0) AS {prefix}_ts_diff_max
  FROM (SELECT session, aid, event_id, CAST(rel - lag(rel) OVER (PARTITION BY session, aid ORDER BY ts, event_id) AS DOUBLE) AS gap,
               nullif(avg(rel) OVER w, 0) AS mean, stddev_samp(rel) OVER w AS sd, min(rel) OVER w AS lo, max(rel) OVER w AS hi
        FROM (SELECT *, ts - (SELECT min(ts) FROM {src}) AS rel FROM {src}) WINDOW w AS (PARTITION BY session, aid))"""


@query("af_item_time_gaps", with_(EV, KNOWN, body=_gaps_sql("known", "aid", False)),
       longs="session aid event_id", doubles=" ".join(ITEM_GAPS))
def item_gaps(spark, d):
    return af.pair_gaps(inputs.known(spark, d), "aid", with_std=False)


@query("af_item_table", with_(EV, KNOWN, LW, *ITEM_CTES, *LW_CTES, body=f"""
  SELECT i.*, {', '.join(f'0 AS {c}' for c in ITEM_GAPS)}, {', '.join(f'coalesce({c}, -1) AS {c}' for c in ITEM_LW)}
  FROM item i LEFT JOIN (SELECT aid AS lw_aid, {_RENAMED} FROM recent) r ON r.lw_aid = i.aid"""),
       longs="aid", doubles=" ".join(ITEM + ITEM_GAPS + ITEM_LW))
def item_table(spark, d):
    return af.item_table(inputs.known(spark, d), inputs.dates(spark, d).test_from)


# Sessions --------------------------------------------------------------------

@query("sf_session_basic", with_(EV, TEST, *SESSION_CTES, body="SELECT * FROM sess"),
       longs="session", doubles=" ".join(SESSION))
def session_basic(spark, d):
    return sf.session_basic(inputs.test(spark, d))


def _session_part(name: str, wanted: list[str]) -> None:
    @query(name, with_(EV, TEST, *SESSION_CTES, body="SELECT * FROM sess"), longs="session", doubles=" ".join(wanted))
    def run(spark, d):
        return sf.session_basic(inputs.test(spark, d)).select("session", *wanted)


_session_part("sf_weekday_histogram", [f"session_inter_day_{d}" for d in DAYS])
_session_part("sf_type_share", [f"session_percent_count_{e}" for e in EVENT_TYPES])
_session_part("sf_per_type_items", [f"session_aid_{s}_{e}" for e in EVENT_TYPES for s in ("count", "nunique")])


@query("sf_session_time_gaps", with_(EV, TEST, body=_gaps_sql("test", "session", True)),
       longs="session aid event_id", doubles=" ".join(SESSION_GAPS))
def session_gaps(spark, d):
    return sf.session_gaps(inputs.test(spark, d))


_DELAYS = [f"session_{a}_{b}_ts_diff" for a, b in (("click", "cart"), ("click", "order"), ("cart", "order"))]


@query("sf_first_event_delays", with_(EV, TEST, body="""
  SELECT session, coalesce(o1 - o0, 0) AS session_click_cart_ts_diff, coalesce(o2 - o0, 0) AS session_click_order_ts_diff,
         coalesce(o2 - o1, 0) AS session_cart_order_ts_diff
  FROM (SELECT session, min(ts) FILTER (type = 0) AS o0, min(ts) FILTER (type = 1) AS o1,
               min(ts) FILTER (type = 2) AS o2 FROM test GROUP BY 1)"""), longs="session", doubles=" ".join(_DELAYS))
def delays(spark, d):
    return sf.first_event_delays(inputs.test(spark, d))


def _funnel_query(name: str, event: str, by_span: bool) -> None:
    where = "" if event == "all" else f"WHERE type = {sf.FUNNEL_TYPES[event]}"
    norm = sql.span("test") if by_span else "CAST(max(len) AS DOUBLE)"
    names = [f"inter_percent_aid_{event}_{c}_occ" for c in ("first", "last")]

    @query(name, with_(EV, TEST, body=f"""
  SELECT session, aid, min(pos) / {norm} AS {names[0]}, max(pos) / {norm} AS {names[1]}
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS pos,
               count(*) OVER (PARTITION BY session) AS len FROM test {where}) GROUP BY 1, 2"""),
           longs="session aid", doubles=" ".join(names))
    def run(spark, d):
        return sf.session_funnel(inputs.test(spark, d), event, by_span)


_funnel_query("sf_session_funnel", "all", True)
_funnel_query("sf_session_funnel_carts_by_length", "cart", False)


@query("sf_time_weighted_count", with_(EV, TEST, sql.marked("m", "test"), body="""
  SELECT session, aid, max(n + rel / CAST(last AS DOUBLE)) AS num_inter_on_aid_ts_sum
  FROM (SELECT session, aid, rel, count(*) OVER (PARTITION BY session, aid) AS n,
               max(rel) OVER (PARTITION BY session) AS last FROM m) GROUP BY 1, 2"""),
       longs="session aid", doubles="num_inter_on_aid_ts_sum")
def time_weighted(spark, d):
    return sf.time_weighted_count(inputs.test(spark, d))


def _clock_query(name: str, absolute: bool) -> None:
    base = "test" if absolute else "(SELECT session, aid, type, event_id, ts - (SELECT min(ts) FROM test) AS ts FROM test)"
    counts = [f"count(*) FILTER (day = {i}) OVER w / {sql.span('test')} AS day{i}cnt" for i in DAYS]
    counts += [f"count(*) FILTER (hour = {i}) OVER w / {sql.span('test')} AS hour{i}cnt" for i in range(24)]
    names = ["hm_mean", "hm_std", *[f"day{i}cnt" for i in DAYS], *[f"hour{i}cnt" for i in range(24)]]

    @query(name, with_(EV, TEST, f"""c AS (
  SELECT *, {sql.WEEKDAY} AS day, {sql.HOUR} AS hour, {sql.HOUR} * 100 + ((ts % 3600) // 60 * 100) // 60 AS hm FROM {base})""",
                       body=f"""
  SELECT session, aid, ts, type, event_id, day, hour, hm, avg(hm) OVER w AS hm_mean,
         coalesce(stddev_samp(hm) OVER w, 0) AS hm_std, {', '.join(counts)} FROM c WINDOW w AS (PARTITION BY session)"""),
           longs="session aid ts type event_id day hour hm", doubles=" ".join(names))
    def run(spark, d):
        return sf.session_clock(inputs.test(spark, d), absolute)


_clock_query("sf_session_clock", False)
_clock_query("sf_session_clock_absolute", True)


@query("sf_percentile", with_(EV, body="""
  SELECT session, quantile_cont(ts, 0.25) AS percentile_25 FROM ev GROUP BY 1"""),
       longs="session", doubles="percentile_25")
def percentile(spark, d):
    return sf.percentile(inputs.events(spark, d), ["session"], "ts", 25)


@query("sf_session_table", with_(EV, TEST, *SESSION_CTES, body=f"""
  SELECT *, {', '.join(f'0 AS {c}' for c in SESSION_GAPS)} FROM sess"""),
       longs="session", doubles=" ".join(SESSION + SESSION_GAPS))
def session_table(spark, d):
    return sf.session_table(inputs.test(spark, d))


# Interactions ------------------------------------------------------------------

def _kind_ctes(kind: str) -> tuple[list[str], list[str]]:
    """CTE x_<kind> (session, aid, its 10 columns) and the column names."""
    code = xf.KINDS[kind]
    where = "" if code is None else f"WHERE type = {code}"
    tsw = "inter" if kind == "all" else kind
    t = sql.span("test")
    names = [f"num_{tsw}_on_aid_tsw_{s}" for s in ("max", "mean", "std")]
    names += [f"inter_aid_{kind}_{p}_occ_ts" for p in ("first", "last", "avg")]
    names += [f"inter_percent_aid_{kind}_{p}_occ" for p in ("first", "last", "avg")]
    names += [f"inter_percent_{tsw}_aid"]
    cte = f"""x_{kind} AS (
  SELECT session, aid, max(w) / {t} AS {names[0]}, avg(w) / {t} AS {names[1]}, coalesce(stddev_samp(w), 0) / {t} AS {names[2]},
         min(rel) AS {names[3]}, max(rel) AS {names[4]}, avg(rel) AS {names[5]},
         min(pos) / CAST(max(len) AS DOUBLE) AS {names[6]}, max(pos) / CAST(max(len) AS DOUBLE) AS {names[7]},
         avg(pos) / CAST(max(len) AS DOUBLE) AS {names[8]}, count(*) / {t} AS {names[9]}
  FROM (SELECT *, n + coalesce(rel / CAST(nullif(last, 0) AS DOUBLE), 0) AS w
        FROM (SELECT session, aid, rel, count(*) OVER (PARTITION BY session, aid) AS n,
                     max(rel) OVER (PARTITION BY session) AS last, count(*) OVER (PARTITION BY session) AS len,
                     row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS pos FROM mt {where}))
  GROUP BY 1, 2)"""
    return [cte], names


X_CTES: list[str] = [sql.marked("mt", "test")]
X_NAMES: list[str] = []
for _k in xf.KINDS:
    _c, _n = _kind_ctes(_k)
    X_CTES += _c
    X_NAMES += _n
X_BODY = "SELECT x_all.session, x_all.aid, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in X_NAMES) + " FROM x_all " + " ".join(
    f"LEFT JOIN x_{k} ON x_{k}.session = x_all.session AND x_{k}.aid = x_all.aid" for k in xf.KINDS if k != "all")


@query("xf_interaction_basic", with_(EV, TEST, *X_CTES, body=X_BODY), longs="session aid", doubles=" ".join(X_NAMES))
def interaction_basic(spark, d):
    return xf.interaction_basic(inputs.test(spark, d))


def _x_part(name: str, pick) -> None:
    wanted = [n for n in X_NAMES if pick(n)]

    @query(name, with_(EV, TEST, *X_CTES, body=X_BODY), longs="session aid", doubles=" ".join(wanted))
    def run(spark, d):
        return xf.interaction_basic(inputs.test(spark, d)).select("session", "aid", *wanted)


_x_part("xf_time_weighted_counts", lambda n: "_tsw_" in n)
_x_part("xf_location_funnel", lambda n: "_occ" in n)
_x_part("xf_interaction_rate", lambda n: n.startswith("inter_percent_") and n.endswith("_aid"))

STATS = ("nunique", "mean", "min", "max")
HOUR_NAMES = [f"inter_{e}_{u}_{s}" for e in ("all", *EVENT_TYPES) for u in ("day", "hour") for s in STATS]


def _hours_cte(out: str, intended: bool) -> str:
    t = sql.span("test")
    cols = []
    for e in ("all", *EVENT_TYPES):
        cond = "true" if e == "all" else f"type = {EVENT_TYPES[e]}" + ("" if intended else " AND place = 1")
        for u in ("day", "hour"):
            cols += [f"count(DISTINCT {u}) FILTER ({cond}) / {t} AS inter_{e}_{u}_nunique"]
            cols += [f"coalesce({f}({u}) FILTER ({cond}), 0) AS inter_{e}_{u}_{s}"
                     for s, f in (("mean", "avg"), ("min", "min"), ("max", "max"))]
    return f"""{out} AS (
  SELECT session, aid, {', '.join(cols)}
  FROM (SELECT *, row_number() OVER (PARTITION BY session, aid ORDER BY ts, event_id) AS place FROM mt) GROUP BY 1, 2)"""


@query("xf_interaction_hours", with_(EV, TEST, X_CTES[0], _hours_cte("h", False), body="SELECT * FROM h"),
       longs="session aid", doubles=" ".join(HOUR_NAMES))
def interaction_hours(spark, d):
    return xf.interaction_hours(inputs.test(spark, d))


@query("xf_interaction_hours_intended", with_(EV, TEST, X_CTES[0], _hours_cte("h", True), body="SELECT * FROM h"),
       longs="session aid", doubles=" ".join(HOUR_NAMES))
def interaction_hours_intended(spark, d):
    return xf.interaction_hours(inputs.test(spark, d), intended=True)


def _times_query(event: str) -> None:
    @query(f"xf_interaction_times_{event}", with_(EV, TEST, X_CTES[0], body=f"""
  SELECT session, aid, 1 AS inter_item_{event}, min(rel) AS {event}_first_ts, max(rel) - min(rel) AS {event}_last_ts,
         avg(rel) AS {event}_avg_ts FROM mt WHERE type = {EVENT_TYPES[event]} GROUP BY 1, 2"""),
           longs=f"session aid inter_item_{event} {event}_first_ts {event}_last_ts", doubles=f"{event}_avg_ts")
    def run(spark, d):
        return xf.interaction_times(inputs.test(spark, d), event)


for _e in EVENT_TYPES:
    _times_query(_e)


def _before_query(name: str, strict: bool) -> None:
    cond = "AND a.ts < b.ts" if strict else ""

    @query(name, with_(EV, body=f"""
  SELECT a.session, a.aid, count(*) AS num_0_before_1 FROM ev a JOIN ev b
  ON a.session = b.session AND a.aid = b.aid AND a.type = 0 AND b.type = 1 {cond} GROUP BY 1, 2"""),
           longs="session aid num_0_before_1")
    def run(spark, d):
        return xf.events_before(inputs.events(spark, d), 0, 1, strict)


_before_query("xf_clicks_before_carts", False)
_before_query("xf_clicks_before_carts_strict", True)


@query("xf_interaction_table", with_(EV, TEST, *X_CTES, _hours_cte("h", False), f"xb AS ({X_BODY})", body="""
  SELECT * FROM xb JOIN h USING (session, aid)"""), longs="session aid", doubles=" ".join(X_NAMES + HOUR_NAMES))
def interaction_table(spark, d):
    return xf.interaction_table(inputs.test(spark, d))
