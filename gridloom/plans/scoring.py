"""Scoring queries; samples are derived from events: uid user_id % 50, test event_id % 2, answer the event's type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as V
from ..operators import scoring as S
from .grids import BASE, derived
from .registry import query

_S = "WITH s AS (SELECT user_id % 50 AS uid, event_id % 2 AS test_idx, event_id AS sample_idx, event_type AS answer, value FROM events) "
_VOTE = _S + ", v AS (SELECT uid, test_idx, answer, count(*) votes, min(sample_idx) seen FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY uid, test_idx ORDER BY votes DESC, seen) AS rank FROM v) "


def samples(t):
    return t("events").select((F.col("user_id") % 50).alias("uid"), (F.col("event_id") % 2).alias("test_idx"), F.col("event_id").alias("sample_idx"), F.col("event_type").alias("answer"), "value")


@query(_VOTE + "SELECT uid, test_idx, answer, votes, rank::INT AS rank FROM k WHERE rank <= 2")
def vote_top2(t):
    return S.vote(samples(t))


@query(_S + ", v AS (SELECT a.uid, b.test_idx, a.answer, count(*) votes, min(a.test_idx * 1099511627776 + a.sample_idx) seen FROM s a JOIN (SELECT DISTINCT uid, test_idx FROM s) b ON a.uid = b.uid AND a.test_idx <= b.test_idx GROUP BY ALL) SELECT uid, test_idx, answer, votes, row_number() OVER (PARTITION BY uid, test_idx ORDER BY votes DESC, seen)::INT AS rank FROM v QUALIFY rank <= 2")
def vote_top2_cumulative(t):
    return S.vote(samples(t), cumulative=True)


def _truth(t):
    return samples(t).groupBy("uid", "test_idx").agg(F.min_by("answer", "sample_idx").alias("answer"))


@query(_VOTE + ", t AS (SELECT uid, test_idx, min_by(answer, sample_idx) answer FROM s GROUP BY ALL), h AS (SELECT t.uid, t.test_idx, max(CASE WHEN k.answer IS NULL THEN 0 ELSE 1 END) hit FROM t LEFT JOIN k ON k.uid = t.uid AND k.test_idx = t.test_idx AND k.answer = t.answer AND k.rank <= 2 GROUP BY ALL), u AS (SELECT uid, avg(hit) share FROM h GROUP BY uid) SELECT round(sum(share), 6) AS solved, count(*) AS problems, round(sum(share) / count(*), 6) AS accuracy FROM u")
def pass_at_2(t):
    return S.pass_at_2(S.vote(samples(t)), _truth(t))


@query(_VOTE + ", f AS (SELECT * FROM k WHERE rank <= 2 AND uid % 3 = 0 AND NOT (uid % 2 = 0 AND test_idx = 0)), g AS (SELECT * FROM k WHERE rank <= 1), a AS (SELECT DISTINCT uid FROM f WHERE test_idx = 0) SELECT uid, test_idx, answer, rank::INT AS rank FROM f WHERE uid IN (SELECT uid FROM a) UNION ALL SELECT uid, test_idx, answer, rank::INT FROM g WHERE uid NOT IN (SELECT uid FROM a)")
def ensemble_coalesce(t):
    top = S.vote(samples(t)).drop("votes")
    first = top.filter("uid % 3 = 0 AND NOT (uid % 2 = 0 AND test_idx = 0)")
    return S.ensemble(first, top.filter("rank <= 1"))


_V = "WITH v AS (SELECT l_orderkey AS uid, l_linenumber AS sample_idx, k, CASE WHEN k = 2 THEN 'test' ELSE 'train' END kind, CASE WHEN l_quantity > 45 AND k = 1 THEN NULL ELSE (l_quantity * (k + 1))::BIGINT % 5 <> 0 END ok FROM lineitem, range(3) r(k)), r AS (SELECT uid, sample_idx, bool_and(coalesce(ok, false)) FILTER (kind = 'train') train_verdict, bool_and(coalesce(ok, false)) train_test_verdict, round(avg(coalesce(ok, false)::INT), 6) ratio FROM v GROUP BY ALL) "


def _verdicts(t):
    long = t("lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("sample_idx"), "l_quantity", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    ok = F.when((F.col("l_quantity") > 45) & (F.col("k") == 1), None).otherwise((F.col("l_quantity") * (F.col("k") + 1)).cast("long") % 5 != 0)
    return long.select("uid", "sample_idx", F.when(F.col("k") == 2, "test").otherwise("train").alias("kind"), ok.alias("ok"))


@query(_V + "SELECT uid, sample_idx, train_verdict, train_test_verdict, ratio FROM r")
def verdict_rollup(t):
    return S.verdict_rollup(_verdicts(t))


@query(_V + "SELECT uid, bool_or(train_test_verdict) AS accepted, max(ratio) AS best, min(ratio) AS worst FROM r GROUP BY uid")
def accepted_samples(t):
    return S.accepted(S.verdict_rollup(_verdicts(t)))


_C = "WITH c AS (SELECT user_id AS idx, event_id AS ord, event_type || ' ' AS txt, event_type AS clean, value AS score FROM events), g AS (SELECT idx, clean, count(*) frequency, round(avg(score), 6) mean_score, min_by(txt, ord) AS text, min(ord) AS seen FROM c GROUP BY ALL) "


@query(_C + "SELECT idx, clean, frequency, mean_score, text, row_number() OVER (PARTITION BY idx ORDER BY frequency DESC, mean_score DESC, seen)::INT AS rank FROM g")
def frequency_rerank(t):
    c = t("events").select(F.col("user_id").alias("idx"), F.col("event_id").alias("ord"), F.concat("event_type", F.lit(" ")).alias("text"), F.col("event_type").alias("clean"), F.col("value").alias("score"))
    return S.frequency_rerank(c)


@query("SELECT user_id, event_id, round(sum((event_type = 'click')::INT) OVER w / count(*) OVER w, 6) AS accuracy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_accuracy(t):
    rows = t("events").select("user_id", "event_id", (F.col("event_type") == "click").alias("correct"))
    return S.running_accuracy(rows, "user_id", "event_id").select("user_id", "event_id", "accuracy")


@query("SELECT event_id, round(sum((event_type = 'click')::INT) OVER w / count(*) OVER w, 6) AS accuracy FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_accuracy_of_all(t):
    rows = t("events").select("event_id", (F.col("event_type") == "click").alias("correct"))
    return S.running_accuracy(rows, None, "event_id").select("event_id", "accuracy")


_ORDERS = "WITH t AS (SELECT p_partkey, [1, 2, 3][1:1 + p_partkey % 3] train FROM part), o AS (SELECT p_partkey, len(train) n, unnest(CASE len(train) WHEN 1 THEN [[1]] WHEN 2 THEN [[1, 2], [2, 1]] ELSE [[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]] END) o FROM t) "


@query(_ORDERS + "SELECT p_partkey AS uid, array_to_string(o, ',') AS train FROM o")
def permutation_expansion(t):
    train = F.slice(F.array(*[F.lit(k) for k in (1, 2, 3)]), 1, (1 + F.col("p_partkey") % 3).cast("int"))
    out = S.permuted_tasks(t("part").select(F.col("p_partkey").alias("uid"), train.alias("train")), 6)
    return out.select("uid", F.array_join(F.transform("train", lambda x: x.cast("string")), ",").alias("train"))


@query(BASE + ", u AS (SELECT g, min(p_partkey) uid FROM p GROUP BY g) SELECT p_partkey, uid FROM p JOIN u USING (g)")
def grid_key_join(t):
    g = derived(t("part")).withColumnRenamed("g", "input")
    tests = g.groupBy("input").agg(F.min("p_partkey").alias("uid")).withColumn("test_idx", F.lit(0))
    return S.grid_key_join(g, tests).select("p_partkey", "uid")


_T = "WITH t AS (SELECT conv_id AS uid, list(turn ORDER BY turn) train FROM conversations GROUP BY conv_id) "


def _tasks(t):
    turns = F.array_sort(F.collect_list("turn"))
    return t("conversations").groupBy(F.col("conv_id").alias("uid")).agg(turns.alias("train")).withColumn("test", F.col("train"))


@query(_T + "SELECT uid, k::INT AS held, array_to_string(list_filter(train, lambda x: x <> train[k + 1]), ',') AS rest FROM t, range(100) r(k) WHERE k < len(train) AND len(train) <> 2")
def leave_one_out(t):
    return S.leave_one_out(_tasks(t)).select("uid", "held", F.array_join(F.transform("train", lambda x: x.cast("string")), ",").alias("rest"))


@query(_T + "SELECT concat(uid, '-', k) AS uid, train[k + 1]::BIGINT AS pair FROM t, range(100) r(k) WHERE k < len(train)")
def test_pair_explode(t):
    return S.test_pairs(_tasks(t)).select("uid", F.get("test", 0).cast("long").alias("pair"))


@query("SELECT user_id AS uid, array_to_string(list(event_id ORDER BY event_type, event_id)[1:5], ',') AS items FROM events GROUP BY user_id")
def merge_lists_cap(t):
    parts = t("events").groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("ord")).agg(F.array_sort(F.collect_list("event_id")).alias("items"))
    return S.merge_lists(parts, 5).select("uid", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT user_id, count(DISTINCT event_type) = 1 AS deterministic FROM events GROUP BY user_id")
def determinism(t):
    return S.all_equal(t("events").select("user_id", F.col("event_type").alias("answer")), "user_id")


_NORM = "sqrt(list_sum(list_transform({}, lambda x: x * x)))"
_COS = "list_dot_product(a.v, b.v) / (" + _NORM.format("a.v") + " * " + _NORM.format("b.v") + ")"


_TOPK = f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), s AS (SELECT a.vec_id query_id, b.vec_id, {_COS} score FROM e a, e b WHERE a.vec_id % 20 = 0) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 4"


@query(_TOPK)
def cosine_topk(t):
    e = t("embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.top_k(q, e, 4).withColumn("score", F.round("score", 6))


@query(_TOPK)
def cosine_topk_cells(t):
    """The same by an inverted file."""
    e = t("embeddings")
    index = V.CellIndex(e, cells=32)
    out = index.top_k(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 4)
    index.drop()
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings) SELECT a.vec_id, round({_COS}, 6) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def pairwise_similarity(t):
    e = t("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT vec_id, (2 * len(embedding))::INT AS size, round(2 * list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def embedding_concat(t):
    both = F.concat(V.doubles(F.col("embedding")), V.doubles(F.col("embedding")))
    return t("embeddings").select("vec_id", F.size(both).alias("size"), F.round(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
