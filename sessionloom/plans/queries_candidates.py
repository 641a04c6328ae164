"""Queries on candidate generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.operators import candidates as ca
from sessionloom.operators import covisitation as cv
from sessionloom.plans import inputs, sql
from sessionloom.plans.queries_basics import ANCHORS, WEIGHTS
from sessionloom.plans.registry import query
from sessionloom.plans.sql import EV, KNOWN, TEST, with_

MOMENT = "ts * 1000000000 + event_id"
HIST = f"""hist AS (
  SELECT session, aid, max({MOMENT}) AS seen, min({MOMENT}) AS opened,
         max(CASE WHEN type IN (1, 2) THEN {MOMENT} END) AS bought FROM test GROUP BY 1, 2)"""

# Neighbour tables of the SQL twins: all-pairs distances of the given vectors.
VECTORS = """cosine_all AS (
  SELECT a.vec_id AS id, b.vec_id AS nb,
         list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dot,
         sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
            * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS norms,
         list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
  FROM embeddings a CROSS JOIN embeddings b)"""
W2V = """word2vec AS (
  SELECT * FROM (SELECT id AS aid, nb AS neighbor, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rank
                 FROM cosine_all WHERE id <> nb) WHERE rank <= 50)"""
BPR = """bpr AS (
  SELECT * FROM (SELECT id AS aid, nb AS neighbor,
                        row_number() OVER (PARTITION BY id ORDER BY round(dot / norms, 12) DESC, nb) AS rank
                 FROM cosine_all WHERE id <> nb) WHERE rank <= 29)"""
RECS = """recs AS (
  SELECT * FROM (SELECT id AS session, nb AS aid, row_number() OVER (PARTITION BY id ORDER BY dot DESC, nb) AS rank
                 FROM cosine_all) WHERE rank <= 30)"""


def _matrices(top: int) -> list[str]:
    out = []
    for rule in ("clicks", "cart_orders", "buy_to_buy"):
        out += sql.matrix(f"mx_{rule}", "known", rule, top, ANCHORS, WEIGHTS)
        out.append(f"{rule} AS (SELECT aid_x AS aid, aid_y AS neighbor, rank FROM mx_{rule})")
    return out


def _tables(spark, d, top: int, vectors: bool):
    known = inputs.known(spark, d)
    rules = {"clicks": cv.clicks_rule(ANCHORS), "cart_orders": cv.cart_orders_rule(WEIGHTS),
             "buy_to_buy": cv.buy_to_buy_rule()}
    out = {n: ca.matrix_neighbours(cv.covisitation(known, r, top)) for n, r in rules.items()}
    if vectors:
        seeds = inputs.test(spark, d)  # only neighbours of their items are ever looked up
        out["word2vec"] = inputs.neighbours(spark, d, 50, "euclidean", seeds)
        out["bpr"] = inputs.neighbours(spark, d, 29, "cosine", seeds)
    return out


def popular_sql(k: int) -> str:
    return f"""pop AS (
  SELECT * FROM (SELECT type, aid, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, aid) AS rank
                 FROM (SELECT type, aid, count(*) AS n FROM test GROUP BY 1, 2)) WHERE rank <= {k})"""


def score_sql(alpha: float, weights: dict[int, float]) -> str:
    w = " ".join(f"WHEN {t} THEN {x}" for t, x in sorted(weights.items()))
    return f"""score AS (
  SELECT session, aid, sum((pow(2.0, {alpha} + (i - 1) * (CASE WHEN n > 1 THEN {1.0 - alpha} / (n - 1) ELSE 0 END)) - 1.0)
                           * CASE type {w} END) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i,
               count(*) OVER (PARTITION BY session) AS n FROM test) GROUP BY 1, 2)"""


def _votes_sql(name: str, seeds: str, sources, n_recs: int) -> str:
    """A CTE of votes (session, aid, o1, o2, o3): source number, recency of the seed, rank."""
    parts = []
    for i, s in enumerate(sources, start=1):
        moment = "bought" if s.buys_only else "seen"
        parts.append(f"""SELECT h.session, t.neighbor AS aid, {i} AS o1, -h.{moment} AS o2, t.rank AS o3
      FROM {seeds} h JOIN {s.table} t ON h.aid = t.aid
      WHERE t.rank BETWEEN {s.first} AND {s.last} AND h.{moment} IS NOT NULL""")
    if n_recs:
        parts.append(f"""SELECT session, aid, {len(sources) + 1}, 0, n FROM (
        SELECT r.session, r.aid, row_number() OVER (PARTITION BY r.session ORDER BY r.rank) AS n FROM recs r
        WHERE r.session IN (SELECT session FROM {seeds})
          AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.session = r.session AND h.aid = r.aid)) WHERE n <= {n_recs}""")
    if not parts:
        parts = ["SELECT NULL::BIGINT AS session, NULL::BIGINT AS aid, 0 AS o1, 0 AS o2, 0 AS o3 WHERE false"]
    return f"{name} AS (" + "\n    UNION ALL ".join(parts) + ")"


def suggest_ctes(spec: ca.CandidateSpec, out: str = "cand") -> list[str]:
    """CTEs from hist (and the neighbour tables) to ``out`` (session, aid, rank, rec)."""
    c = spec.candidates
    quota = int(c * spec.share)
    return [
        "sizes AS (SELECT session, count(*) AS n_hist FROM hist GROUP BY 1)",
        f"hs AS (SELECT hist.*, n_hist FROM hist JOIN sizes USING (session) WHERE n_hist < {c})",
        f"hl AS (SELECT hist.*, n_hist FROM hist JOIN sizes USING (session) WHERE n_hist >= {c})",
        popular_sql(c),
        _votes_sql("vs", "hs", spec.short, spec.session_recs_short),
        _votes_sql("vl", "hl", spec.long, spec.session_recs_long),
        """vsr AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY votes DESC, place) AS vr,
         max(votes) OVER (PARTITION BY session) AS top
  FROM (SELECT session, aid, count(*) AS votes, min((o1, o2, o3)) AS place FROM vs GROUP BY 1, 2))""",
        f"""voted AS (
  SELECT v.session, v.aid, row_number() OVER (PARTITION BY v.session ORDER BY v.vr) AS k,
         CAST(v.votes AS DOUBLE) / v.top AS rec FROM vsr v
  WHERE v.vr <= {c} AND NOT EXISTS (SELECT 1 FROM hs h WHERE h.session = v.session AND h.aid = v.aid))""",
        f"""own AS (
  SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY seen DESC) AS rank, 1.5 AS rec FROM hs
  UNION ALL
  SELECT v.session, v.aid, s.n_hist + v.k, v.rec FROM voted v JOIN sizes s USING (session)
  WHERE v.k <= {quota} - s.n_hist)""",
        f"""filled AS (
  SELECT session, aid, rank, rec FROM own
  UNION ALL
  SELECT s.session, p.aid, (SELECT count(*) FROM own o WHERE o.session = s.session)
         + row_number() OVER (PARTITION BY s.session ORDER BY p.rank), 0.0
  FROM sizes s JOIN pop p ON p.type = {spec.popular_type}
  WHERE s.n_hist < {c} AND NOT EXISTS (SELECT 1 FROM own o WHERE o.session = s.session AND o.aid = p.aid))""",
        score_sql(spec.alpha, spec.type_weights),
        f"""longs AS (
  SELECT session, aid, rank, 1.5 AS rec FROM (
    SELECT session, aid, row_number() OVER (
             PARTITION BY session ORDER BY round(sum(score) + sum(votes) * {spec.long_vote}, 9) DESC, min(place)) AS rank
    FROM (SELECT session, aid, s.score, 0 AS votes, (0, h.opened, 0) AS place
          FROM score s JOIN hl h USING (session, aid)
          UNION ALL
          SELECT session, aid, 0.0, count(*), min((o1, o2, o3)) FROM vl GROUP BY 1, 2) GROUP BY 1, 2)
  WHERE rank <= {c})""",
        f"""{out} AS (
  SELECT session, aid, rank, rec FROM filled WHERE rank <= {c} UNION ALL SELECT session, aid, rank, rec FROM longs)""",
    ]


# Parts -----------------------------------------------------------------------

@query("ca_history", with_(EV, TEST, HIST, body="""
  SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY seen DESC) AS rank FROM hist"""),
       longs="session aid rank")
def history(spark, d):
    return ca.history_ranked(inputs.test(spark, d))


@query("ca_history_buys", with_(EV, TEST, HIST, body="""
  SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY bought DESC) AS rank FROM hist
  WHERE bought IS NOT NULL"""), longs="session aid rank")
def history_buys(spark, d):
    return ca.history_ranked(inputs.test(spark, d), buys_only=True)


def _score_query(name: str, alpha: float) -> None:
    @query(name, with_(EV, TEST, score_sql(alpha, WEIGHTS), body="SELECT * FROM score"),
           longs="session aid", doubles="score")
    def run(spark, d):
        return ca.recency_score(inputs.test(spark, d), alpha, WEIGHTS).select("session", "aid", "score")


_score_query("ca_recency_score_clicks", 0.1)
_score_query("ca_recency_score_carts", 0.5)


@query("ca_neighbour_lookup", with_(EV, KNOWN, TEST, HIST, *_matrices(80), body="""
  SELECT h.session, h.aid, t.neighbor, t.rank FROM hist h JOIN cart_orders t ON h.aid = t.aid WHERE t.rank <= 10"""),
       longs="session aid neighbor rank")
def lookup(spark, d):
    return ca.neighbour_lookup(ca.history(inputs.test(spark, d)), _tables(spark, d, 80, False)["cart_orders"], 10)


def _vector_lookup(name: str, table: str, cte: str, metric: str, stored: int, k: int) -> None:
    @query(name, with_(EV, TEST, HIST, VECTORS, cte, body=f"""
  SELECT h.session, h.aid, t.neighbor, t.rank FROM hist h JOIN {table} t ON h.aid = t.aid WHERE t.rank <= {k}"""),
           longs="session aid neighbor rank")
    def run(spark, d):
        test = inputs.test(spark, d)
        return ca.neighbour_lookup(ca.history(test), inputs.neighbours(spark, d, stored, metric, test), k)


_vector_lookup("ca_word2vec_neighbours", "word2vec", W2V, "euclidean", 50, 10)
_vector_lookup("ca_bpr_neighbours", "bpr", BPR, "cosine", 29, 3)


@query("ca_bpr_session_recs", with_(EV, TEST, HIST, VECTORS, RECS, body="""
  SELECT * FROM (
    SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY rank) AS rank FROM recs r
    WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.session = r.session AND h.aid = r.aid)) WHERE rank <= 3"""),
       longs="session aid rank")
def session_recs(spark, d):
    return ca.unseen_session_recs(inputs.session_recs(spark, d), ca.history(inputs.test(spark, d)), 3)


_CARTS = ca.carts_spec(60, 60, 10).only("clicks", "cart_orders", "buy_to_buy")


@query("ca_source_votes", with_(EV, KNOWN, TEST, HIST, *_matrices(80), _votes_sql("v", "hist", _CARTS.short, 0), body="""
  SELECT session, aid, votes, place[1] AS source, place[3] AS source_rank FROM (
    SELECT session, aid, count(*) AS votes, min([o1, o2, o3]) AS place FROM v GROUP BY 1, 2)"""),
       longs="session aid votes source source_rank")
def votes(spark, d):
    counted = ca.vote_counts(ca.source_votes(
        ca.history(inputs.test(spark, d)), _tables(spark, d, 80, False), _CARTS.short))
    return counted.select("session", "aid", "votes", F.col("place.source").alias("source"),
                          F.col("place.rank").alias("source_rank"))


@query("ca_popular_items", with_(EV, TEST, popular_sql(20), body="SELECT * FROM pop"), longs="type aid n rank")
def popular(spark, d):
    return ca.popular_items(inputs.test(spark, d), 20)


# Whole suggestions -------------------------------------------------------------

def _suggest_query(name: str, spec: ca.CandidateSpec, vectors: bool) -> None:
    ctes = [EV, KNOWN, TEST, HIST, *_matrices(80)] + ([VECTORS, W2V, BPR, RECS] if vectors else [])

    @query(name, with_(*ctes, *suggest_ctes(spec), body="SELECT * FROM cand"), longs="session aid rank", doubles="rec")
    def run(spark, d):
        test = inputs.test(spark, d)
        recs = inputs.session_recs(spark, d, wanted=test) if vectors else None
        return ca.suggest(test, _tables(spark, d, 80, vectors), spec, recs)


_suggest_query("ca_suggest_clicks_matrices", ca.clicks_spec(20, 60, 10).only("clicks", "cart_orders", "buy_to_buy"), False)
_suggest_query("ca_suggest_carts_matrices", ca.carts_spec(20, 60, 10).only("clicks", "cart_orders", "buy_to_buy"), False)
_suggest_query("ca_suggest_clicks", ca.clicks_spec(60, 60, 10), True)
_suggest_query("ca_suggest_carts", ca.carts_spec(60, 60, 10), True)
_suggest_query("ca_suggest_orders", ca.orders_spec(60, 60, 10), True)
_suggest_query("ca_suggest_carts_long_history", ca.carts_spec(10, 60, 10), True)
_suggest_query("ca_suggest_orders_long_history", ca.orders_spec(10, 60, 10), True)
_suggest_query("ca_suggest_clicks_share", ca.clicks_spec(40, 40, 5, share=0.5), True)


@query("ca_candidate_count_check",
       with_(EV, KNOWN, TEST, HIST, *_matrices(80),
             *suggest_ctes(ca.clicks_spec(20).only("clicks", "cart_orders")), body="""
  SELECT CASE WHEN bool_and(n = 20) THEN 1 ELSE 0 END AS all_equal, count(*) AS sessions,
         count(*) FILTER (n < 20) AS short_lists FROM (SELECT session, count(*) AS n FROM cand GROUP BY 1)"""),
       longs="all_equal sessions short_lists")
def check(spark, d):
    spec = ca.clicks_spec(20).only("clicks", "cart_orders")
    return ca.candidate_check(ca.suggest(inputs.test(spark, d), _tables(spark, d, 80, False), spec), 20)
