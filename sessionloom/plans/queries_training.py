"""Queries that fit models. Results depend on fitted numbers; the queries return what must hold of any of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sessionloom.operators import embeddings as em
from sessionloom.operators import factors as fa
from sessionloom.operators import metrics as mt
from sessionloom.operators import ranker as rk
from sessionloom.operators import sessions
from sessionloom.operators import training as tr
from sessionloom.plans import facts, inputs
from sessionloom.plans.pipelines import SETUPS, Run, smaller
from sessionloom.plans.queries_basics import ANCHORS, NEXT, scratch
from sessionloom.plans.queries_models import FOLD, LABELLED, labelled, merged
from sessionloom.plans.registry import query
from sessionloom.plans.sql import EV, TEST, with_
from sessionloom.sources.tables import cut_lineage

#: The published parameters, but for the rounds: a round is one job for each of six levels (see the README for its time).
FIT = rk.RankerParams(rounds=4, early_stop=4)


def _rows(spark, d):
    return cut_lineage(tr.fold_by_hash(tr.select_features(merged(spark, d))))


def _learnt(model, rows) -> bool:
    """Whether the scores order the rows that a model was fitted on better than equal scores do."""
    rows = rows.select("session", "aid", "target", F.lit(0.0).alias("score"), *model[0].columns)
    scored = rk.score_folds(model, rows).join(rows.select("session", "aid", "target"), ["session", "aid"])
    return rk.mean_average_precision(scored.withColumnRenamed("pred", "score")) > rk.mean_average_precision(rows)


PER_SESSION = "SELECT session, least(count(*), 20) AS entries, 1 AS in_order, 1 AS learnt FROM cl {where} GROUP BY 1"


def _told(scored, learnt: bool):
    """Per session the entries of its answer, whether its scores fall from place to place, and whether the fit learnt anything."""
    top = mt.top_predictions(scored, with_score=True).withColumnsRenamed({"pos": "rank", "pred": "score"})
    return facts.lists_in_order(top, "session").withColumn("learnt", F.lit(learnt))


@query("md_single_model_predictions", with_(*LABELLED, body=PER_SESSION.format(where=f"WHERE {FOLD} = 0")),
       longs="session entries in_order learnt")
def single_model(spark, d):
    """Train on four folds, rank the fifth. The rows it was trained on are ranked better than by equal scores."""
    rows = _rows(spark, d)
    fitted, scored = rk.train_fold(rows, 0, 0.10, tr.feature_names(), FIT)
    return _told(scored, _learnt([fitted], tr.sample_negatives(tr.split_fold(rows, 0)[0], 0.10)))


@query("md_feature_importance", with_(*LABELLED, body="SELECT count(*) > 0 AS named, 1 AS falling, 1 AS from_trees FROM cl"),
       longs="named falling from_trees")
def importance(spark, d):
    """Mean and summed gains of the columns that split: known names, falling, and above 0 the sum of all splits' gains."""
    columns, rows = tr.feature_names(), _rows(spark, d)
    fitted = rk.train(tr.sample_negatives(tr.split_fold(rows, 0)[0], 0.10), None, columns, FIT)
    gains = cut_lineage(rk.feature_importance(fitted))
    order = facts.lists_in_order(gains.withColumn("score", F.col("gain")).withColumn("all", F.lit(0)), "all")
    whole = sum(float(t.gain.sum()) for t in fitted.trees)
    told = gains.agg(F.bool_and(F.col("feature").isin(columns)).alias("named"),
                     ((F.abs(F.sum("total_gain") - whole) < 1e-6 * (1 + whole)) & F.lit(whole > 0)).alias("from_trees"))
    return told.select("named", order.select("in_order").scalar().alias("falling"), "from_trees")


@query("md_fold_ensemble_predictions", with_(*LABELLED, body=PER_SESSION.format(where="")), longs="session entries in_order learnt")
def fold_ensemble(spark, d):
    """The mean of the fold models ranks all sessions in one pass, and the rows they were trained on better than equal scores.

    A fold whose training part has no session with both classes, as in tiny tables, lends no model.
    """
    rows, columns = _rows(spark, d), tr.feature_names()
    few = replace(FIT, rounds=2)
    parts = [tr.sample_negatives(tr.split_fold(rows, f)[0], 0.10) for f in range(5)]
    fitted = [rk.train(part, None, columns, few) for part in parts if rk.trainable(part)]
    return _told(rk.score_folds(fitted, rows), _learnt(fitted, tr.sample_negatives(rows, 0.10)))


@query("md_mean_score", with_(*LABELLED, body="""
  SELECT session, aid, pos FROM (
    SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY (rec + cvm_weights + aid + 2 * aid % 7 + aid % 3) / 5 DESC, aid) AS pos
    FROM cl) WHERE pos <= 10"""), longs="session aid pos")
def mean_score(spark, d):
    """Mean of five given scores, then the best ten."""
    rows = tr.with_rank_weight(labelled(spark, d), 20).select(
        "session", "aid", F.col("rec").alias("s1"), F.col("cvm_weights").alias("s2"), F.col("aid").alias("s3"),
        (2 * F.col("aid") % 7).alias("s4"), (F.col("aid") % 3).alias("s5"))
    return mt.top_predictions(rk.mean_score(rows, ["s1", "s2", "s3", "s4", "s5"]), 10)


@query("md_rules_submission", with_(EV, TEST, body="""
  SELECT session || '_' || e AS session_type, 20 AS entries, 20 AS different
  FROM (SELECT DISTINCT session FROM test) CROSS JOIN (VALUES ('clicks'), ('carts'), ('orders')) v(e)"""),
       longs="entries different", texts="session_type")
def rules_submission(spark, d):
    """The whole rules-only job with written tables: every session and event has twenty different labels."""
    run = Run(inputs.known(spark, d), inputs.test(spark, d), scratch(spark, "rules"),
              smaller(SETUPS["rules"], anchors=ANCHORS))
    labels = F.split("labels", " ")
    return run.rules_answer().select("session_type", F.size(labels).alias("entries"), F.size(F.array_distinct(labels)).alias("different"))


#: A short job for trial runs: two folds of five, two rounds at depth 3, 20 candidates of 60, few dealings of the factor blocks.
TRIAL = smaller(
    SETUPS["0val"], anchors=ANCHORS, candidates=20, folds=2, rounds=2, early_stop=2, max_depth=3, leaf=64,
    word2vec=replace(fa.WORD2VEC, passes=5), bpr=replace(fa.BPR, passes=50))

#: The published job; only the anchors of the click pairs' weights follow the given tables' dates.
WHOLE = smaller(SETUPS["0val"], anchors=ANCHORS)


def trained_run(spark, d, folder: str, setup=TRIAL) -> Run:
    """The whole job with vectors, by default as a trial."""
    return Run(inputs.known(spark, d), inputs.test(spark, d), folder, setup)


@query("md_trained_submission", with_(EV, TEST, body="""
  SELECT session || '_' || e AS session_type, 20 AS entries, 20 AS different
  FROM (SELECT DISTINCT session FROM test) CROSS JOIN (VALUES ('clicks'), ('carts'), ('orders')) v(e)"""),
       longs="entries different", texts="session_type")
def trained_submission(spark, d):
    """Validation by folds, then the submission by the fold models, with the published setup: every session and event has twenty different labels."""
    run = trained_run(spark, d, scratch(spark, "trained"), WHOLE)
    _, models = run.validate(inputs.labels(spark, d))
    labels = F.split("labels", " ")
    return run.answer(models).select("session_type", F.size(labels).alias("entries"), F.size(F.array_distinct(labels)).alias("different"))


# Factors -------------------------------------------------------------------------

#: All epochs at full width; blocks are dealt anew every ten of them.
BPR = replace(fa.BPR, passes=10)
ITEMS = "SELECT DISTINCT aid, {width} AS width, 1 AS sound FROM ev"
ONE_ROW = "SELECT count(DISTINCT aid) AS items, 1 AS in_order, 1 AS true_scores, 1 AS recalled FROM ev"


@query("em_word2vec_vectors", with_(EV, body=ITEMS.format(width=fa.WORD2VEC.width)), longs="aid width sound")
def word2vec(spark, d):
    return facts.sound_vectors(fa.word2vec(inputs.events(spark, d)))


@query("em_word2vec_neighbours", with_(EV, body=ONE_ROW), longs="items in_order true_scores recalled")
def word2vec_neighbours(spark, d):
    """Approximate neighbours of the fitted vectors from leaves of 16 to 21 items, in order, with true scores, and most of the exact ones among them."""
    vectors = fa.word2vec(inputs.events(spark, d))
    return facts.neighbour_facts(em.similar_items(vectors, 10, leaf=16), vectors, 10, 0.9)


@query("em_next_item_factors", with_(EV, NEXT.format(src="ev"), body=f"""
  SELECT DISTINCT aid, {fa.NEXT_ITEM.width} AS width, 1 AS sound FROM (SELECT aid FROM nxt UNION ALL SELECT aid_next FROM nxt)"""),
       longs="aid width sound")
def next_item(spark, d):
    return facts.sound_vectors(fa.next_item_factors(sessions.next_items(inputs.events(spark, d))))


@query("em_next_item_accuracy", with_(EV, NEXT.format(src="ev"), body="""
  SELECT count(*) // 10 AS held, count(*) - count(*) // 10 AS trained, 1 AS judged, 1 AS learnt FROM nxt"""),
       longs="held trained judged learnt")
def next_item_accuracy(spark, d):
    """The newest tenth of the pairs is held out; pairs with a shifted second item are the negatives.

    The held pairs can be judged, and the fitted vectors tell the pairs they were fitted on from
    the negatives better than chance would.
    """
    pairs = cut_lineage(sessions.next_items(inputs.events(spark, d)))
    n, items = pairs.agg(F.count("*"), F.greatest(F.max("aid"), F.max("aid_next"))).first()
    held = cut_lineage(sessions.tail_holdout(pairs, n // 10))
    vectors = fa.next_item_factors(held.filter("not is_valid"))

    def accuracy(rows):
        shifted = rows.withColumn("aid_next", F.pmod(F.col("aid_next") + 37, F.lit(items + 1)))
        return em.pair_accuracy(rows, shifted, vectors).select("accuracy").scalar()

    counts = held.agg(F.count_if("is_valid").alias("held"), F.count_if(~F.col("is_valid")).alias("trained"))
    return counts.select("held", "trained", accuracy(held.filter("is_valid")).isNotNull().alias("judged"),
                         (accuracy(held.filter("not is_valid")) > 0.5).alias("learnt"))


@query("em_bpr_item_vectors", with_(EV, body=f"SELECT DISTINCT aid, {fa.BPR.width + 1} AS width, 1 AS sound, 1 AS learnt FROM ev"),
       longs="aid width sound learnt")
def bpr_items(spark, d):
    """Sound vectors; and of the items that they put first for a session, more are among its own than of the most popular."""
    counts = cut_lineage(sessions.item_counts(inputs.events(spark, d)))
    users, items = fa.bpr(counts, BPR)
    share = facts.own_share(em.recommend(users, items, 10), counts)
    popular = facts.own_share(facts.popular_for_all(counts, 10), counts)
    return facts.sound_vectors(items).withColumn("learnt", F.lit(share > popular))


@query("em_bpr_session_recommendations", with_(EV, body="""
  SELECT session, least(30, (SELECT count(DISTINCT aid) FROM ev) - count(DISTINCT aid)) AS entries, 1 AS in_order, 0 AS seen
  FROM ev GROUP BY 1 HAVING count(DISTINCT aid) < (SELECT count(DISTINCT aid) FROM ev)"""), longs="session entries in_order seen")
def bpr_recommendations(spark, d):
    """Thirty items a session has not seen, as far as there are so many, best first."""
    counts = sessions.item_counts(inputs.events(spark, d))
    users, items = fa.bpr(counts, BPR)
    found = cut_lineage(em.recommend(users, items, 30, seen=counts))
    known = found.join(counts.select("session", "aid", F.lit(1).alias("k")), ["session", "aid"], "left").groupBy("session").agg(
        F.count("k").alias("seen"))
    return facts.lists_in_order(found, "session").join(known, "session")


@query("em_bpr_similar_items", with_(EV, body=ONE_ROW), longs="items in_order true_scores recalled")
def bpr_similar(spark, d):
    vectors = fa.bpr(sessions.item_counts(inputs.events(spark, d)), BPR)[1]
    return facts.neighbour_facts(em.similar_items(vectors, 29, leaf=32), vectors, 29, 0.9)


@query("em_context_pairs", """
  WITH e AS (SELECT user_id AS session, CAST(json_extract(props, '$.k') AS INTEGER) AS aid,
                    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS pos
             FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')),
       m AS (SELECT x.aid AS p, y.aid AS q, y.pos - x.pos AS gap FROM e x JOIN e y
             ON x.session = y.session AND y.pos - x.pos BETWEEN 1 AND 3)
  SELECT a, b, sum(4 - gap) / 3.0 AS n FROM (SELECT p AS a, q AS b, gap FROM m UNION ALL SELECT q, p, gap FROM m)
  GROUP BY 1, 2""", longs="a b", doubles="n")
def context_pairs(spark, d):
    return fa.context_pairs(inputs.events(spark, d), 3)
