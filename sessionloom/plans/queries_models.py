"""Queries on training rows, splits, answers, recall and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES, RECALL_WEIGHTS
from sessionloom.operators import candidates as ca
from sessionloom.operators import embeddings as em
from sessionloom.operators import interaction_features as xf
from sessionloom.operators import item_features as af
from sessionloom.operators import metrics as mt
from sessionloom.operators import session_features as sf
from sessionloom.operators import sessions
from sessionloom.operators import stratify as st
from sessionloom.operators import training as tr
from sessionloom.plans import facts, inputs, sql
from sessionloom.plans import queries_features as qf
from sessionloom.plans.queries_basics import NEXT, scratch
from sessionloom.plans.queries_candidates import HIST, VECTORS, _matrices, _tables, suggest_ctes
from sessionloom.plans.registry import query
from sessionloom.plans.sql import EV, KNOWN, LABELS, TEST, VEC, spread, with_
from sessionloom.sources import tables

C = 20
SPECS = {e: ca.SPECS[e](C, 60, 10).only("clicks", "cart_orders", "buy_to_buy") for e in ("clicks", "carts", "orders")}
CAND = [EV, KNOWN, TEST, HIST, *_matrices(80), *suggest_ctes(SPECS["carts"])]
STEP = 0.5 / (C - 1)


def candidates(spark, d, event: str = "carts"):
    return ca.suggest(inputs.test(spark, d), _tables(spark, d, 80, False), SPECS[event])


def labelled(spark, d, event: str = "carts"):
    return tr.with_truth(candidates(spark, d, event), inputs.labels(spark, d), event)


TRUTH = """cl AS (
  SELECT c.session, c.aid, c.rank, c.rec, CASE WHEN t.aid IS NULL THEN 0 ELSE 1 END AS target,
         pow(2.0, 1.0 - (c.rank - 1) * {step}) - 1.0 AS cvm_weights
  FROM cand c LEFT JOIN (SELECT DISTINCT session, unnest(ground_truth) AS aid FROM truth WHERE type = '{event}') t
  ON t.session = c.session AND t.aid = c.aid)"""
LABELLED = [*CAND, LABELS, TRUTH.format(step=STEP, event="carts")]


# Training rows -----------------------------------------------------------------

@query("tr_candidates_truth", with_(*LABELLED, body="SELECT * FROM cl"), longs="session aid rank target", doubles="rec")
def truth(spark, d):
    return labelled(spark, d)


@query("tr_rank_weight", with_(*CAND, body=f"""
  SELECT session, aid, pow(2.0, 1.0 - (rank - 1) * {STEP}) - 1.0 AS cvm_weights FROM cand"""),
       longs="session aid", doubles="cvm_weights")
def rank_weight(spark, d):
    return tr.with_rank_weight(candidates(spark, d), C).select("session", "aid", "cvm_weights")


@query("tr_group_folds_deal", with_(EV, body=f"""
  SELECT session, (row_number() OVER (ORDER BY {spread('session')}, session) - 1) % 5 AS fold
  FROM (SELECT DISTINCT session FROM ev)"""), longs="session fold")
def folds_deal(spark, d):
    return tr.fold_deal(inputs.events(spark, d))


LIGHTEST = "CASE " + " ".join(f"WHEN l{k} <= least({', '.join(f'l{j}' for j in range(k + 1, 5))}) THEN {k}" for k in range(4)) + " ELSE 4 END"


@query("tr_group_folds_size", f"""
  WITH RECURSIVE {EV},
  sized AS (SELECT session, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, session) AS i FROM ev GROUP BY 1),
  dealt AS (
    SELECT CAST(0 AS BIGINT) AS i, -1 AS fold, CAST(0 AS BIGINT) AS size, {', '.join(f'CAST(0 AS BIGINT) AS l{k}' for k in range(5))}
    UNION ALL
    SELECT s.i, f AS fold, s.size, {', '.join(f'l{k} + CASE WHEN f = {k} THEN s.size ELSE 0 END' for k in range(5))}
    FROM (SELECT i AS before, l0, l1, l2, l3, l4, {LIGHTEST} AS f FROM dealt) d JOIN sized s ON s.i = d.before + 1)
  SELECT fold, size, count(*) AS sessions FROM dealt WHERE i > 0 GROUP BY 1, 2""", longs="fold size sessions")
def folds_size(spark, d):
    """Sessions with unequal numbers of events: the largest to the lightest fold; told by fold and size."""
    return tr.fold_by_size(inputs.events(spark, d).select("session"), 5).groupBy("fold", "size").agg(F.count("*").alias("sessions"))


FOLD = f"({spread('session')}) % 5"


@query("tr_group_folds_hash", with_(EV, body=f"SELECT DISTINCT session, {FOLD} AS fold FROM ev"), longs="session fold")
def folds_hash(spark, d):
    return tr.fold_by_hash(inputs.events(spark, d).select("session").distinct())


@query("tr_fold_split", with_(EV, body=f"""
  SELECT CASE WHEN {FOLD} = 2 THEN 'valid' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT session) AS sessions
  FROM ev GROUP BY 1"""), longs="n sessions", texts="part")
def fold_split(spark, d):
    train, valid = tr.split_fold(tr.fold_by_hash(inputs.events(spark, d)), 2)
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


KEEP = f"(({spread('session', 42)}) * 31 + ({spread('aid', 42)})) % 1000000 < 100000"


@query("tr_negative_sample", with_(*LABELLED, body=f"""
  SELECT session, aid, target FROM cl WHERE target = 1 OR {KEEP}"""), longs="session aid target")
def negatives(spark, d):
    return tr.sample_negatives(labelled(spark, d), 0.10).select("session", "aid", "target")


@query("tr_negative_sample_random", with_(*LABELLED, body="SELECT sum(target) AS positives, 1 AS share_fits FROM cl"),
       longs="positives share_fits")
def negatives_random(spark, d):
    """All positives stay, and of n negatives a tenth, up to five standard deviations."""
    rows = tables.cut_lineage(labelled(spark, d))
    n = rows.filter("target = 0").count()
    kept = tr.sample_negatives_random(rows, 0.10).agg(F.sum("target").alias("positives"), F.count_if(F.col("target") == 0).alias("k"))
    return kept.select("positives", (F.abs(F.col("k") - 0.1 * n) <= 5 * (0.09 * n) ** 0.5).alias("share_fits"))


@query("tr_group_sizes", with_(*LABELLED, body=f"""
  SELECT session, count(*) AS group_size FROM cl WHERE target = 1 OR {KEEP} GROUP BY 1"""), longs="session group_size")
def group_sizes(spark, d):
    return tr.group_sizes(tr.sample_negatives(labelled(spark, d), 0.10))


FEATURES = tr.feature_names()
ITEM_COLS = qf.ITEM + qf.ITEM_GAPS + qf.ITEM_LW
SESSION_COLS = qf.SESSION + qf.SESSION_GAPS
PAIR_COLS = qf.X_NAMES + qf.HOUR_NAMES
MERGED = [
    *LABELLED, qf.LW, *qf.ITEM_CTES, *qf.LW_CTES, *qf.SESSION_CTES, *qf.X_CTES, qf._hours_cte("h", False),
    f"xb AS ({qf.X_BODY})",
    f"""fi AS (SELECT i.*, {', '.join(f'0 AS {c}' for c in qf.ITEM_GAPS)}, {', '.join(f'coalesce({c}, -1) AS {c}' for c in qf.ITEM_LW)}
  FROM item i LEFT JOIN (SELECT aid AS lw_aid, {qf._RENAMED} FROM recent) r ON r.lw_aid = i.aid)""",
    f"fs AS (SELECT *, {', '.join(f'0 AS {c}' for c in qf.SESSION_GAPS)} FROM sess)",
    "fx AS (SELECT * FROM xb JOIN h USING (session, aid))",
    f"""merged AS (
  SELECT cl.session, cl.aid, cl.target, cl.cvm_weights, cl.rec,
         {', '.join(f'coalesce({c}, -1) AS {c}' for c in ITEM_COLS + SESSION_COLS + PAIR_COLS)}
  FROM cl LEFT JOIN fi ON fi.aid = cl.aid LEFT JOIN fs ON fs.session = cl.session
  LEFT JOIN fx ON fx.session = cl.session AND fx.aid = cl.aid)""",
]


def merged(spark, d, event: str = "carts"):
    rows = tables.cut_lineage(tr.with_rank_weight(labelled(spark, d, event), C))
    return tr.merge_features(rows, af.item_table(inputs.known(spark, d), inputs.dates(spark, d).test_from),
                             sf.session_table(inputs.test(spark, d)), xf.interaction_table(inputs.test(spark, d)))


@query("tr_feature_merge", with_(*MERGED, body="SELECT * FROM merged"), longs="session aid target",
       doubles=" ".join(FEATURES))
def feature_merge(spark, d):
    return tr.select_features(merged(spark, d))


SUBSET = FEATURES[:12] + FEATURES[60:64] + ["rec"]


@query("tr_feature_selection", with_(*MERGED, body=f"SELECT session, aid, target, {', '.join(SUBSET)} FROM merged"),
       longs="session aid target", doubles=" ".join(SUBSET))
def feature_selection(spark, d):
    return merged(spark, d).select("session", "aid", "target", *SUBSET)


@query("tr_early_stop_set", with_(EV, body=f"""
  SELECT event_id, session, CASE WHEN dense_rank() OVER (ORDER BY session) <= 12 THEN 1 ELSE 0 END AS is_eval
  FROM ev WHERE {FOLD} = 2"""), longs="event_id session is_eval")
def early_stop(spark, d):
    _, valid = tr.split_fold(tr.fold_by_hash(inputs.events(spark, d)), 2)
    return tr.early_stop_set(valid, 12).select("event_id", "session", "is_eval")


# Stratified splits and score profiles --------------------------------------------

def _dealt(seed: str, extra: str = "") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY quality, toxic{extra} ORDER BY {seed}, doc_id) AS pos FROM labels"""


STARTS = """starts AS (
  SELECT quality, toxic, n, coalesce(sum(n) OVER (ORDER BY quality, toxic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2))"""
PAIR = ["quality", "toxic"]


@query("st_stratified_folds", with_(STARTS, body=f"""
  SELECT doc_id, quality, toxic, (start + pos - 1) % 3 AS fold FROM ({_dealt(spread('doc_id'))}) JOIN starts USING (quality, toxic)"""),
       longs="doc_id quality toxic fold")
def stratified(spark, d):
    return st.stratified_folds(inputs.scores(spark, d), "doc_id", PAIR, 3)


@query("st_repeated_folds", with_(STARTS, body=f"""
  SELECT doc_id, quality, toxic, repeat, (start + pos - 1) % 5 AS fold
  FROM (SELECT l.*, r.range AS repeat,
               row_number() OVER (PARTITION BY r.range, quality, toxic ORDER BY {spread('doc_id + r.range * 1000003', 1)}, doc_id) AS pos
        FROM labels l CROSS JOIN range(10) r) JOIN starts USING (quality, toxic)"""),
       longs="doc_id quality toxic repeat fold")
def repeated(spark, d):
    return st.repeated_folds(inputs.scores(spark, d), "doc_id", PAIR, 5, 10)


@query("st_stratified_split", with_(STARTS, body=f"""
  SELECT doc_id, quality, toxic, CASE WHEN pos <= floor(n * 0.1 + 0.5) THEN 1 ELSE 0 END AS is_test
  FROM ({_dealt(spread('doc_id'))}) JOIN starts USING (quality, toxic)"""), longs="doc_id quality toxic is_test")
def split(spark, d):
    return st.stratified_split(inputs.scores(spark, d), "doc_id", PAIR, 0.1)


#: Eight labels from the signs of vectors: rows with a large component have the label, so that most label vectors are unique.
MARKS = [f"m{i}" for i in range(8)]
MARKED = "marked AS (SELECT vec_id, " + ", ".join(f"CASE WHEN embedding[{i + 1}] > 0.1 THEN 1 ELSE 0 END AS m{i}" for i in range(8)) + " FROM embeddings)"
IN_LONG = "long AS (" + " UNION ALL ".join(f"SELECT 'm{i}' AS label, m{i} AS has FROM marked" for i in range(8)) + " UNION ALL SELECT 'rows', 1 FROM marked)"
LABEL_SHARES = "SELECT label, fold, sum(has) AS total, 1 AS within FROM long, (SELECT range AS fold FROM range({folds})) f GROUP BY 1, 2"


def marked_vectors(spark, d):
    v = inputs.vectors(spark, d)
    return v.select("id", *[(F.get("vec", F.lit(i)) > F.lit(0.1)).cast("int").alias(f"m{i}") for i in range(8)])


def label_shares(dealt, weights, keys=()):
    """Per label (and the rows as such) and fold: the label's rows in all, and whether the fold has its (broken) share up to one row."""
    whole = sum(weights)
    counts = dealt.groupBy(*keys, "fold").agg(F.count("*").alias("rows"), *[F.sum(m).alias(m) for m in MARKS])
    long = counts.unpivot([*keys, "fold"], ["rows", *MARKS], "label", "n")
    totals = long.groupBy(*keys, "label").agg(F.sum("n").alias("total"))
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("fold").cast("int") + 1)
    return long.join(totals, [*keys, "label"]).select(
        *keys, "label", "fold", "total", (F.abs(F.col("n") * whole - F.col("total") * share) < 2 * whole).alias("within"))


@query("st_label_folds", with_(MARKED, IN_LONG, body=LABEL_SHARES.format(folds=5)), longs="fold total within", texts="label")
def label_folds(spark, d):
    """Rows dealt label by label: each of eight labels is spread over five folds up to one row."""
    return label_shares(st.label_folds(marked_vectors(spark, d), "id", MARKS, 5), [1] * 5)


@query("st_repeated_label_folds", with_(MARKED, IN_LONG, body=f"""
  SELECT r.range AS repeat, s.* FROM ({LABEL_SHARES.format(folds=5)}) s CROSS JOIN range(10) r"""),
       longs="repeat fold total within", texts="label")
def repeated_label_folds(spark, d):
    return label_shares(st.repeated_label_folds(marked_vectors(spark, d), "id", MARKS, 5, 10), [1] * 5, ["repeat"])


@query("st_label_split", with_(MARKED, IN_LONG, body=LABEL_SHARES.format(folds=2)), longs="fold total within", texts="label")
def label_split(spark, d):
    """A tenth of every label to the test part (fold 1), up to one row."""
    dealt = st.label_split(marked_vectors(spark, d), "id", MARKS, 0.1)
    return label_shares(dealt.withColumn("fold", F.col("is_test").cast("int")), [9, 1])


@query("st_value_counts", """
  SELECT 'quality' AS grading_metric, quality AS score, count(*) AS count FROM labels GROUP BY 2
  UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY 2""", longs="score count", texts="grading_metric")
def value_counts(spark, d):
    return st.value_counts(inputs.scores(spark, d), PAIR)


@query("st_mean_histogram", """
  SELECT floor((quality + toxic) / 2.0 / 0.25) AS bin, floor((quality + toxic) / 2.0 / 0.25) * 0.25 AS bin_start,
         count(*) AS count FROM labels GROUP BY 1, 2""", longs="bin count", doubles="bin_start")
def histogram(spark, d):
    return st.mean_histogram(inputs.scores(spark, d), PAIR)


# Answers and recall ----------------------------------------------------------------

@query("md_top_predictions", with_(*CAND, body="""
  SELECT session, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY pos) AS labels FROM (
    SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY -rank DESC, aid) AS pos FROM cand)
  WHERE pos <= 10 GROUP BY 1"""), longs="session", texts="labels")
def top(spark, d):
    scored = candidates(spark, d).withColumn("pred", -F.col("rank"))
    return mt.prediction_lists(mt.top_predictions(scored, 10))


def rules_answer(spark, d, event: str):
    return mt.prediction_lists(candidates(spark, d, event).select("session", "aid", F.col("rank").alias("pos")))


RULES = [EV, KNOWN, TEST, HIST, *_matrices(80), LABELS]


def _rules_ctes(event: str) -> list[str]:
    return [*suggest_ctes(SPECS[event]),
            "pred AS (SELECT session, list(aid ORDER BY rank) AS labels FROM cand GROUP BY 1)"]


HITS = """hits AS (
  SELECT t.session, t.type, coalesce(len(list_intersect(t.ground_truth, p.labels)), 0) AS hits,
         least(len(t.ground_truth), 20) AS truths
  FROM truth t LEFT JOIN pred p ON p.session = t.session)"""


@query("md_rules_only_answer", with_(*RULES, *_rules_ctes("orders"), body="""
  SELECT session, array_to_string(labels, ' ') AS labels FROM pred"""), longs="session", texts="labels")
def rules_only(spark, d):
    return rules_answer(spark, d, "orders")


@query("mt_hits", with_(*RULES, *_rules_ctes("carts"), HITS, body="SELECT * FROM hits WHERE type = 'carts'"),
       longs="session hits truths", texts="type")
def hits(spark, d):
    return mt.hits(inputs.labels(spark, d).filter("type = 'carts'"), rules_answer(spark, d, "carts"))


@query("mt_recall", with_(*RULES, *_rules_ctes("carts"), HITS, body="""
  SELECT type, sum(hits) AS hits, sum(truths) AS truths, sum(hits) / CAST(sum(truths) AS DOUBLE) AS recall
  FROM hits WHERE type = 'carts' GROUP BY 1"""), longs="hits truths", doubles="recall", texts="type")
def recall(spark, d):
    return mt.recall(inputs.labels(spark, d), rules_answer(spark, d, "carts"), "carts")


# A simple answer for all events: the session's own items, newest first. It keeps the SQL twins
# of the recall queries short; the answer by rules is checked above.
OWN = """pred AS (
  SELECT session, list(aid ORDER BY seen DESC)[:20] AS labels FROM hist GROUP BY 1)"""


def own_items(spark, d):
    ranked = ca.history_ranked(inputs.test(spark, d)).filter("rank <= 20")
    return mt.prediction_lists(ranked.withColumnRenamed("rank", "pos"))


OVERALL = "CASE type " + " ".join(f"WHEN '{e}' THEN {w}" for e, w in RECALL_WEIGHTS.items()) + " END"


@query("mt_weighted_recall", with_(EV, TEST, HIST, LABELS, OWN, HITS, """r AS (
  SELECT type, sum(hits) AS hits, sum(truths) AS truths, sum(hits) / CAST(sum(truths) AS DOUBLE) AS recall
  FROM hits GROUP BY 1)""", body=f"""
  SELECT * FROM r UNION ALL SELECT 'all', sum(hits), sum(truths), sum(recall * {OVERALL}) FROM r"""),
       longs="hits truths", doubles="recall", texts="type")
def weighted_recall(spark, d):
    answer = own_items(spark, d)
    return mt.weighted_recall(inputs.labels(spark, d), {e: answer for e in EVENT_TYPES})


@query("mt_fold_summary", with_(EV, TEST, HIST, LABELS, OWN, HITS, body=f"""
  SELECT type, avg(recall) AS mean, stddev_pop(recall) AS std FROM (
    SELECT type, {FOLD} AS fold, sum(hits) / CAST(sum(truths) AS DOUBLE) AS recall FROM hits GROUP BY 1, 2) GROUP BY 1"""),
       doubles="mean std", texts="type")
def fold_summary(spark, d):
    counted = tr.fold_by_hash(mt.hits(inputs.labels(spark, d), own_items(spark, d)))
    recalls = counted.groupBy("type", "fold").agg(
        (F.sum("hits").cast("double") / F.sum("truths").cast("double")).alias("recall"))
    return mt.fold_summary(recalls)


@query("mt_submission", with_(EV, TEST, HIST, OWN, body="""
  SELECT session || '_' || e AS session_type, array_to_string(labels, ' ') AS labels
  FROM pred CROSS JOIN (VALUES ('clicks'), ('carts'), ('orders')) v(e)"""), texts="session_type labels")
def submission(spark, d):
    answer = own_items(spark, d)
    return mt.submission({e: answer for e in EVENT_TYPES})


@query("io_submission_csv", with_(EV, TEST, HIST, OWN, body="""
  SELECT session || '_' || e AS session_type, array_to_string(labels, ' ') AS labels
  FROM pred CROSS JOIN (VALUES ('clicks'), ('carts'), ('orders')) v(e)"""), texts="session_type labels")
def submission_csv(spark, d):
    path = scratch(spark, "submission")
    answer = own_items(spark, d)
    tables.write_submission(mt.submission({e: answer for e in EVENT_TYPES}), path)
    return spark.read.option("header", True).csv(path)


@query("mt_predicted_sessions_only", with_(EV, TEST, LABELS, body="""
  SELECT session, type, array_to_string(ground_truth, ' ') AS ground_truth FROM truth
  WHERE session IN (SELECT session FROM test)"""), longs="session", texts="type ground_truth")
def predicted_only(spark, d):
    return mt.predicted_sessions_only(inputs.labels(spark, d), inputs.test(spark, d).select("session"))


# Vectors -----------------------------------------------------------------------------

@query("em_nearest_items", with_(VECTORS, body="""
  SELECT id AS aid, nb AS neighbor, rank, dist AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rank FROM cosine_all WHERE id <> nb)
  WHERE rank <= 20"""), longs="aid neighbor rank", doubles="score")
def nearest(spark, d):
    return em.nearest_items(inputs.vectors(spark, d), 20)


@query("em_similar_items_by_factors", with_(VECTORS, body="""
  SELECT id AS aid, nb AS neighbor, rank, dot / norms AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dot / norms, 12) DESC, nb) AS rank
    FROM cosine_all WHERE id <> nb) WHERE rank <= 30"""), longs="aid neighbor rank", doubles="score")
def similar_by_factors(spark, d):
    return em.nearest_items(inputs.vectors(spark, d), 30, "cosine")


#: A forest that parts even the smallest given table: leaves of 51 to 101 vectors, in cells of 200 at most.
FOREST = {"trees": 64, "leaf": 100, "cell_rows": 200}


@query("em_similar_items_approximate", """
  SELECT count(*) AS items, 1 AS in_order, 1 AS true_scores, 1 AS recalled, 1 AS parted, 1 AS whole FROM embeddings""",
       longs="items in_order true_scores recalled parted whole")
def similar_approximate(spark, d):
    """All trees part the vectors into eight leaves or more, and their lists hold nine tenths of the exact ones."""
    v = inputs.vectors(spark, d)
    found = facts.neighbour_facts(em.similar_items(v, 50, **FOREST), v, 50, 0.9)
    planted = tables.cut_lineage(facts.forest_facts(v, 50, **FOREST))
    return found.select("*", planted.select("parted").scalar().alias("parted"), planted.select("whole").scalar().alias("whole"))


@query("em_recommend_all_sessions", with_(VECTORS, body="""
  SELECT id AS session, nb AS aid, rank, dot AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, nb) AS rank FROM cosine_all) WHERE rank <= 30"""),
       longs="session aid rank", doubles="score")
def recommend(spark, d):
    return em.recommend(inputs.vectors(spark, d), inputs.vectors(spark, d), 30)


@query("em_recommend_unseen_items", with_(EV, VECTORS, body="""
  SELECT id AS session, nb AS aid, rank, dot AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, nb) AS rank FROM cosine_all c
    WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.session = c.id AND ev.aid = c.nb)) WHERE rank <= 30"""),
       longs="session aid rank", doubles="score")
def recommend_unseen(spark, d):
    v = inputs.vectors(spark, d)
    return em.recommend(v, v, 30, seen=inputs.events(spark, d).select("session", "aid"))


@query("em_session_item_affinity", with_(EV, VEC, body="""
  SELECT p.session, p.aid, list_dot_product(u.vec, v.vec) AS u2i
  FROM (SELECT DISTINCT session, aid FROM ev) p JOIN vec u ON u.id = p.session JOIN vec v ON v.id = p.aid"""),
       longs="session aid", doubles="u2i")
def affinity(spark, d):
    v = inputs.vectors(spark, d)
    return em.affinity(inputs.events(spark, d), v, v)


@query("em_pair_accuracy", with_(EV, VEC, NEXT.format(src="ev"), """pairs AS (
  SELECT aid, aid_next, 1 AS y FROM nxt UNION ALL SELECT aid, (aid_next + 37) % (SELECT max(aid) + 1 FROM ev), -1 FROM nxt)""", body="""
  SELECT count(*) AS pairs, avg(CASE WHEN list_dot_product(u.vec, v.vec) * y > 0 THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM pairs JOIN vec u ON u.id = aid JOIN vec v ON v.id = aid_next"""), longs="pairs", doubles="accuracy")
def pair_accuracy(spark, d):
    ev = inputs.events(spark, d)
    pairs, items = sessions.next_items(ev), ev.agg(F.max("aid") + 1).scalar()
    shifted = pairs.withColumn("aid_next", F.pmod(F.col("aid_next") + 37, items))
    return em.pair_accuracy(pairs, shifted, inputs.vectors(spark, d))


WIDTH = 64


@query("em_embedding_columns", "SELECT vec_id AS aid, " + ", ".join(
    f"embedding[{i + 1}] AS aid_embeddings_{i}" for i in range(WIDTH)) + " FROM embeddings",
       longs="aid", doubles=" ".join(f"aid_embeddings_{i}" for i in range(WIDTH)))
def columns(spark, d):
    return em.vector_columns(inputs.vectors(spark, d), WIDTH, "aid_embeddings")


@query("em_principal_components", """
  SELECT count(*) AS rows, 1 AS centred, 1 AS uncorrelated, 1 AS falling FROM embeddings""", longs="rows centred uncorrelated falling")
def components(spark, d):
    return facts.component_facts(em.principal_components(inputs.vectors(spark, d), 5), 5)
