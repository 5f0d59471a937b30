"""Ledger queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from .registry import query


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(t):
    return L.resume(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT c_custkey, min(o_orderkey) IS NOT NULL AS found, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def exists_missing(t):
    found = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("rank"))
    return L.exists_or_missing(t("customer"), found, "c_custkey", "o_orderkey", "rank")


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def lineage_chain(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    x = x.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    return x.join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey", "n_name")


@query("WITH r AS (SELECT event_id AS id, CASE WHEN event_id >= 7 THEN event_id - 7 END AS p FROM events) SELECT a.id, a.p AS ancestor_1, b.p AS ancestor_2, c.p AS ancestor_3 FROM r a LEFT JOIN r b ON b.id = a.p LEFT JOIN r c ON c.id = b.p")
def ledger_lineage(t):
    rows = t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") >= 7, F.col("event_id") - 7).alias("prev_step_id"))
    return L.lineage(rows)


@query("""WITH RECURSIVE r AS (SELECT event_id AS id, CASE WHEN event_id % 512 >= 3 OR event_id % 7 = 0 THEN event_id - 1 - event_id % 3 END AS p FROM events),
w AS (SELECT id, id AS root, 0::BIGINT AS depth FROM r WHERE p IS NULL OR p NOT IN (SELECT id FROM r) UNION ALL SELECT r.id, w.root, w.depth + 1 FROM w JOIN r ON r.p = w.id)
SELECT r.id, w.root, w.depth, w.id IS NULL AS cyclic FROM r LEFT JOIN w ON w.id = r.id""")
def lineage_roots(t):
    e = F.col("event_id")
    rows = t("events").select(e.alias("id"), F.when((e % 512 >= 3) | (e % 7 == 0), e - 1 - e % 3).alias("prev_step_id"))
    return L.lineage_roots(rows)


@query("SELECT l_orderkey, count(*) AS n, count(*) = 1 AS is_unique FROM lineitem GROUP BY l_orderkey")
def key_uniqueness(t):
    return L.unique_keys(t("lineitem"), "l_orderkey")


@query("SELECT event_id, concat(user_id, '-', floor(value)::BIGINT) AS k FROM events QUALIFY count(*) OVER (PARTITION BY k) > 1")
def duplicate_ids(t):
    return L.duplicated(t("events").select("event_id", F.concat("user_id", F.lit("-"), F.floor("value")).alias("k")), "k")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT c_custkey k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 5 k FROM orders) b ON a.k = b.k")
def reconcile_sets(t):
    return L.reconcile(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select((F.col("o_custkey") + 5).alias("k")), "k")


@query("WITH u AS (SELECT event_type model, sum(user_id) AS tokens_in, sum(event_id) AS tokens_out FROM events GROUP BY event_type) SELECT model, tokens_in::BIGINT AS tokens_in, tokens_out::BIGINT AS tokens_out, round((tokens_in * CASE model WHEN 'click' THEN 1.1 WHEN 'view' THEN 0.15 END + tokens_out * CASE model WHEN 'click' THEN 4.4 WHEN 'view' THEN 0.6 END) / 1000000, 6)::DOUBLE AS cost FROM u")
def usage_cost(t):
    u = t("events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"))
    rates = u.sparkSession.createDataFrame([("click", 1.1, 4.4), ("view", 0.15, 0.6)], "model string, rate_in double, rate_out double")
    return L.usage_cost(u, rates)


_SOUGHT = ["NATION_3", "BUILDING", "1-URGENT", "SMALL", "click", "en", "src1", "user", "R", "F"]
_TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}
_HIT = ", ".join(f"'{v}'" for v in _SOUGHT)


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS hits FROM {t} WHERE {c} IN ({_HIT}) HAVING count(*) > 0" for t, names in _TEXTS.items() for c in names))
def find_value_columns(t):
    """All text columns of all tables."""
    return L.find_in_tables({name: t(name) for name in [*_TEXTS, "embeddings", "labels"]}, _SOUGHT)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def bulk_update(t):
    return L.bulk_update(t("orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH"], "X").select("o_orderkey", "o_orderstatus")


@query("SELECT l_returnflag || '.' || l_linestatus AS reason, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def stat_merge(t):
    return L.merge_counts(t("lineitem").select(F.concat_ws(".", "l_returnflag", "l_linestatus").alias("reason"), F.lit(1).alias("n")))


@query("SELECT c_custkey::VARCHAR AS id, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), c_name, '') AS step_name FROM customer")
def record_normalize(t):
    raw = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("step-name"), F.col("c_name").alias("stepName"))
    return L.normalized_records(raw, {"id": [], "step_name": ["step-name", "stepName"]})


@query("SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER () = 1 AS is_unique FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 4000 AND (l_linenumber = 7 OR l_suppkey = 7 OR l_partkey = 7)")
def value_search(t):
    return L.search(t("lineitem"), 7, ["l_linenumber", "l_suppkey", "l_partkey"], "l_orderkey", 100, 4000).select("l_orderkey", "l_linenumber", "l_quantity", "is_unique")


@query("SELECT o_orderkey, true AS is_unique FROM orders WHERE o_orderkey = 77 AND o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) = 1)")
def value_search_unique(t):
    return L.search(t("orders"), 77, ["o_orderkey"], "o_orderkey", 0, 1 << 40).select("o_orderkey", "is_unique")


_MARK = "md5(concat('5-', user_id, '-', event_id))"


@query(f"SELECT user_id, event_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_MARK}, event_id) <= 60")
def cached_answers(t):
    """Of each customer's answers sixty, or all."""
    from ..operators import models

    requests = t("customer").select(F.col("c_custkey").alias("user_id"))
    return models.cached_answers(requests, t("events").select("user_id", "event_id", "event_type"), 60, "user_id", "event_id", 5)


@query("SELECT c_custkey AS user_id, 60 - count(event_id) AS remaining FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey HAVING count(event_id) < 60")
def lacking_answers(t):
    from ..operators import models

    requests = t("customer").select(F.col("c_custkey").alias("user_id"))
    return models.lacking(requests.unionByName(requests), t("events").select("user_id", "event_id"), 60, "user_id")


@query("SELECT count(*) FILTER (cached) AS hits, count(*) FILTER (NOT cached) AS misses FROM (SELECT doc_id IN (SELECT doc_id FROM labels) cached FROM documents)")
def cache_lookup(t):
    known, missing = L.cached(t("documents").select(F.md5(F.col("doc_id").cast("string")).alias("key")), t("labels").select(F.md5(F.col("doc_id").cast("string")).alias("key")))
    return known.agg(F.count("*").alias("hits")).crossJoin(missing.agg(F.count("*").alias("misses")))
