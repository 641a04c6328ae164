"""SQL building blocks of the twins: common table expressions over the given tables."""

from __future__ import annotations

DAY = 86400
CUT = f"(SELECT (max(ts) // {DAY} + 1) * {DAY} - {7 * DAY} FROM ev)"
TEST_FROM = f"(SELECT (max(ts) // {DAY} + 1) * {DAY} - {14 * DAY} FROM ev)"

EV = """ev AS (
  SELECT user_id AS session, CAST(json_extract(props, '$.k') AS INTEGER) AS aid, epoch_us(ts) // 1000000 AS ts,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS type, event_id
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))"""
KNOWN = f"known AS (SELECT * FROM ev WHERE ts < {CUT})"
TEST = f"test AS (SELECT * FROM ev WHERE ts >= {TEST_FROM} AND ts < {CUT})"
LABELS = f"""truth AS (
  SELECT session, CASE type WHEN 0 THEN 'clicks' WHEN 1 THEN 'carts' ELSE 'orders' END AS type,
         list_sort(list(DISTINCT aid)) AS ground_truth
  FROM ev WHERE ts >= {CUT} GROUP BY 1, 2)"""
OL = """ol AS (
  SELECT o_custkey AS session, CAST(l_partkey AS INTEGER) AS aid, epoch_us(o_orderdate) // 1000000 AS ts,
         CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS type,
         {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey} AS event_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"

WEEKDAY = f"((ts // {DAY} + 3) % 7)"
HOUR = f"((ts % {DAY}) // 3600)"


def spread(key: str, seed: int = 0) -> str:
    return f"((((CAST({key} AS BIGINT) % 2147483647) * 48271 + {11 + seed * 7919}) % 2147483647) * 69621 + 7) % 2147483647"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def span(src: str) -> str:
    return f"(SELECT (max(ts) - min(ts)) / {DAY}.0 FROM {src})"


def matrix(name: str, src: str, rule: str, top: int, anchors: tuple[int, int] | None = None,
           weights: dict[int, float] | None = None) -> list[str]:
    """CTEs of a co-visitation matrix; the last one is ``name`` (aid_x, aid_y, wgt, rank)."""
    window = 7 * DAY if rule == "buy_to_buy" else DAY
    keep = "WHERE type IN (1, 2)" if rule == "buy_to_buy" else ""
    if rule == "clicks":
        lo, hi = anchors
        wgt = f"count(*) + 3.0 * CAST(sum(x_ts - {lo}) AS DOUBLE) / CAST({hi - lo} AS DOUBLE)"
    elif rule == "cart_orders":
        wgt = " + ".join(f"CAST(count(*) FILTER (y_type = {t}) AS DOUBLE) * {w}" for t, w in sorted(weights.items()))
    else:
        wgt = "CAST(count(*) AS DOUBLE)"
    return [
        f"""{name}_tail AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS n
                 FROM {src} {keep}) WHERE n <= 30)""",
        f"""{name}_pairs AS (
  SELECT session, aid_x, aid_y, x_ts, y_ts, y_type FROM (
    SELECT a.session, a.aid AS aid_x, b.aid AS aid_y, a.ts AS x_ts, b.ts AS y_ts, b.type AS y_type,
           row_number() OVER (PARTITION BY a.session, a.aid, b.aid
                              ORDER BY a.ts DESC, b.ts DESC, a.event_id DESC, b.event_id DESC) AS n
    FROM {name}_tail a JOIN {name}_tail b ON a.session = b.session AND a.aid <> b.aid
      AND abs(a.ts - b.ts) < {window}) WHERE n = 1)""",
        f"{name}_wgt AS (SELECT aid_x, aid_y, {wgt} AS wgt FROM {name}_pairs GROUP BY 1, 2)",
        f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid_x ORDER BY wgt DESC, aid_y) AS rank
                 FROM {name}_wgt) WHERE rank <= {top})""",
    ]


def marked(name: str, src: str) -> str:
    """A CTE with weekday, hour and time from the frame's first event."""
    return f"""{name} AS (
  SELECT *, {WEEKDAY} AS day, {HOUR} AS hour, ts - (SELECT min(ts) FROM {src}) AS rel FROM {src})"""
