"""Sources and sinks: tables are written to the shared folder in each form and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import grid as G
from ..functions import text as X
from ..operators import corpus as C
from ..session import dealt, shared_folder
from ..sources import readers, writers
from ..streaming import ingest
from .grids import BASE, derived
from .registry import query


def folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


_PART = schemas.ddl("p_partkey LONG, p_name STRING, p_size INT")


@query("SELECT p_partkey, p_name, p_size FROM part")
def json_lines_scan(t):
    df, at = t("part").select("p_partkey", "p_name", "p_size"), folder(t("part"))
    writers.json_lines(df, at)
    return readers.json_lines(df.sparkSession, at, _PART)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 0")
def json_lines_skip_bad(t):
    df, at = t("part"), folder(t("part"))
    good = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    df.select(F.when(F.col("p_partkey") % 10 == 0, "not json").when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("["), good)).otherwise(good).alias("value")).write.text(at)
    return readers.json_lines(df.sparkSession, at, _PART, skip_bad=True)


@query("SELECT n_nationkey, n_regionkey::INT AS file_ordinal FROM nation WHERE n_regionkey < 3")
def json_files_in_order(t):
    df, at = t("nation"), folder(t("nation"))
    rows = df.orderBy("n_nationkey").collect()  # 25
    files = {k: "".join(f'{{"n_nationkey": {r.n_nationkey}}}\n' for r in rows if r.n_regionkey == k) for k in range(5)}
    writers.named_files(df.sparkSession, {f"r{k}.jsonl": v.encode() for k, v in files.items()}, at)
    return readers.json_files(df.sparkSession, at, schemas.ddl("n_nationkey LONG"), most=3).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("file_ordinal").cast("int").alias("file_ordinal"))


@query("SELECT concat('t', n_nationkey) AS uid, concat('Concept', n_regionkey) AS concept, concat('[[', n_nationkey % 10, ']]') AS grid FROM nation")
def task_folders(t):
    df, at = t("nation"), folder(t("nation"))
    one = '{{"train": [\n {{"input": [[{0}]],\n "output": [[{0}]]}}], "test": []}}'
    writers.named_files(df.sparkSession, {f"Concept{r.n_regionkey}/t{r.n_nationkey}.json": one.format(r.n_nationkey % 10).encode() for r in df.collect()}, at)
    out = readers.tasks(df.sparkSession, at, schemas.TASK)
    return out.select("uid", "concept", F.to_json(F.get("train", 0)["input"]).alias("grid"))


@query("SELECT printf('%08x_A', n_nationkey) AS seed_id, printf('%08x', n_nationkey) AS uid, concat('# ', n_name, chr(10), 'pass') AS content FROM nation")
def seed_programs(t):
    df, at = t("nation"), folder(t("nation"))
    files = {f"{r.n_nationkey:08x}_A.py": f"# {r.n_name}\npass".encode() for r in df.collect()}
    writers.named_files(df.sparkSession, files | {"common.py": b"x", "1234.py": b"y"}, at)
    return readers.seeds(df.sparkSession, at)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', \"x\"' || chr(10) || p_brand AS cell, '[' || p_size || ',null]' AS sizes FROM part")
def csv_round_trip(t):
    df, at = t("part"), folder(t("part"))
    rows = df.select("p_partkey", F.concat("p_name", F.lit(', "x"\n'), "p_brand").alias("cell"), F.array("p_size", F.lit(None)).alias("sizes"))
    writers.csv(rows.filter("p_partkey % 2 = 0"), at)
    writers.csv(rows.filter("p_partkey % 2 = 1"), at, append=True)
    return readers.csv(df.sparkSession, at)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'utf-8' ELSE 'cp949' END AS encoding, concat('é ', n_name) AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'cp949', concat('한 ', n_name) FROM nation WHERE n_nationkey % 2 = 1")
def csv_encodings(t):
    df, at = t("nation"), folder(t("nation"))
    spark, rows = df.sparkSession, df.select("n_nationkey", "n_name").collect()
    files = {}
    for k, (mark, code) in enumerate((("é", "utf-8"), ("한", "cp949"))):
        files[f"{k}.csv"] = ("n_nationkey,name\n" + "".join(f"{r.n_nationkey},{mark} {r.n_name}\n" for r in rows if r.n_nationkey % 2 == k)).encode(code)
    writers.named_files(spark, files, at)
    out = None
    for name, data in files.items():
        code = readers.probe_encoding(data)
        one = readers.csv(spark, f"{at}/{name}", encoding=code).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.lit(code).alias("encoding"), "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey::INT AS ordinal, n_name AS id FROM nation WHERE n_nationkey < 20")
def selector_list(t):
    df, at = t("nation"), folder(t("nation"))
    names = [r.n_name for r in df.orderBy("n_nationkey").select("n_name").collect()]
    writers.named_files(df.sparkSession, {"ids.txt": (", ".join(names[:7]) + ",\n" + ",\n\n".join(names[7:]) + ",\n").encode()}, at)
    return readers.selectors(df.sparkSession, f"{at}/ids.txt", 20).select(F.col("ordinal").cast("int").alias("ordinal"), "id")


@query("SELECT concat(n_name, '.gif') AS name, (len(n_name) * (n_nationkey % 3))::BIGINT AS length, n_nationkey % 3 = 0 AS empty, len(n_name) * (n_nationkey % 3) > 12 AS too_large, base64(encode(repeat(n_name, n_nationkey % 3))) AS base64 FROM nation")
def media_files(t):
    df, at = t("nation"), folder(t("nation"))
    spark = df.sparkSession
    writers.named_files(spark, {f"{r.n_name}.gif": (r.n_name * (r.n_nationkey % 3)).encode() for r in df.collect()} | {"note.txt": b"x"}, at)
    name = F.regexp_extract("path", r"([^/]+)\z", 1).alias("name")
    held = readers.media(spark, at, "*.gif").select(name, "base64")
    return readers.listing(spark, at, "*.gif", 12).select(name, "length", "empty", "too_large").join(held, "name", "left").select("name", "length", "empty", "too_large", F.coalesce("base64", F.lit("")).alias("base64"))


@query(BASE + "SELECT concat('u', p_partkey) AS uid, 'pool' AS source, 2::INT AS pairs, to_json(g)::VARCHAR AS first FROM p")
def problem_cache(t):
    pair = F.struct(F.col("g").alias("input"), F.col("g").alias("output"))
    rows = derived(t("part")).select(F.concat(F.lit("u"), "p_partkey").alias("uid"), F.lit("pool").alias("source"), F.array(pair, pair).alias("examples"), F.array(F.lit("s")).alias("seeds"))
    at = folder(rows)
    writers.problem_cache(rows, at)
    out = readers.problem_cache(rows.sparkSession, at)
    return out.select("uid", "source", F.size("examples").alias("pairs"), F.to_json(F.get("examples", 0)["output"]).alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM part WHERE p_size % 4 <> 0 UNION ALL SELECT p_partkey, 'test' FROM part WHERE p_size % 4 = 0")
def train_test_save(t):
    rows, at = t("part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "test").otherwise("train").alias("split")), folder(t("part"))
    writers.splits(rows, at)
    one = lambda s: readers.dataset(rows.sparkSession, at, f"split={s}").withColumn("split", F.lit(s))
    return one("train").unionByName(one("test"))


@query("SELECT printf('%08x-0000-4000-8000-000000000000', n_nationkey) AS uuid FROM nation WHERE n_nationkey % 2 = 0")
def media_log(t):
    df, at = t("nation"), folder(t("nation"))
    uid = F.concat(F.lower(F.lpad(F.hex("n_nationkey"), 8, "0")), F.lit("-0000-4000-8000-000000000000"))
    df.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("12:00 read /data/pool/x_"), uid, F.lit(".gif done"))).otherwise("12:00 nothing").alias("value")).write.text(at)
    return readers.media_ids(df.sparkSession, at)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM part")
def json_lines_append(t):
    rows, at = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "first").otherwise("second").alias("batch")), folder(t("part"))
    writers.json_lines(rows.filter("batch = 'first'"), at)
    writers.json_lines(rows.filter("batch = 'second'"), at, append=True)
    return readers.json_lines(rows.sparkSession, at, schemas.ddl("p_partkey LONG, batch STRING"))


@query("SELECT o_orderstatus AS step_name, count(*) AS n FROM orders GROUP BY ALL")
def ledger_append(t):
    rows, at = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("step_name")), folder(t("orders"))
    for k in range(3):
        writers.ledger(rows.filter(F.col("id") % 3 == k), at)
    return rows.sparkSession.read.parquet(at).groupBy("step_name").agg(F.count("*").alias("n"))


@query("SELECT ((row_number() OVER (ORDER BY c_custkey) - 1) // 40)::INT AS batch, concat(c_custkey, ',') AS value FROM customer")
def id_chunks(t):
    at = folder(t("customer"))
    writers.id_batches(t("customer"), at, "c_custkey", 40)
    return t("customer").sparkSession.read.text(at).select(F.col("batch").cast("int").alias("batch"), "value")


@query("SELECT count(*) AS sections, count(*) AS anchors, sum(2 * n * m)::BIGINT AS cells FROM (SELECT 3 + n_nationkey % 4 AS n, 3 + n_nationkey % 3 AS m FROM nation)")
def grid_report(t):
    rows = derived(t("nation").select(F.col("n_nationkey").alias("p_partkey"), F.col("n_nationkey").alias("p_size")))
    pair = F.struct(F.col("g").alias("input"), F.col("g").alias("output"))
    sections = rows.select(F.concat(F.lit("u"), "p_partkey").alias("uid"), X.problem_html(F.concat(F.lit("u"), "p_partkey"), F.array(pair), F.lit("R0lG")).alias("html"))
    at = folder(rows)
    writers.page(rows.sparkSession, sections, f"{at}/report.html", "Problems")
    page = rows.sparkSession.read.text(at, wholetext=True)
    n = lambda p: F.size(F.regexp_extract_all("value", F.lit(p), F.lit(0))).cast("long")
    return page.select(n("<section id=").alias("sections"), n('<a href="#u').alias("anchors"), n('<td class="').alias("cells"))


@query(BASE + "SELECT p_partkey, array_to_string(list_transform(range(n), lambda i: concat(array_to_string(list_transform(range(m), lambda j: concat(chr(27), '[48;5;', [16, 21, 196, 34, 226, 244, 201, 208, 37, 88][g[i+1][j+1]+1], 'm  ')), ''), chr(27), '[0m')), chr(10)) AS txt FROM p")
def console_grid(t):
    return derived(t("part")).select("p_partkey", X.grid_ansi(F.col("g")).alias("txt"))


@query("SELECT event_id, event_type FROM events")
def landing_folder(t):
    """Two files land, and the folder is taken in twice: every row once."""
    rows, at = t("events").select("event_id", "event_type"), folder(t("events"))
    for k in range(2):
        rows.filter(F.col("event_id") % 2 == k).write.parquet(f"{at}/land/{k}")
        for _ in range(2):
            ingest.once(ingest.landing(rows.sparkSession, f"{at}/land/*", rows.schema), f"{at}/out", f"{at}/state")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/out")


@query("SELECT event_id, ts, event_type FROM events")
def resumed_ingestion(t):
    """Three landings: the second brings the first third again, the third comes after it with the oldest rows of all. Each event once."""
    e, at = t("events").select("event_id", "ts", "event_type"), folder(t("events"))
    third = F.pmod(F.col("event_id"), F.lit(3))
    for k, new in enumerate([e.filter(third == 1), e.filter(third != 0), e.filter(third != 2)]):
        new.write.parquet(f"{at}/land/{k}")
        ingest.resumed(ingest.landing(e.sparkSession, f"{at}/land/*", e.schema), "event_id", f"{at}/out", f"{at}/state")
    return e.sparkSession.read.schema(e.schema).parquet(f"{at}/out")


@query("WITH e AS (SELECT event_id, ts, event_type FROM events), w AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM e WHERE event_id % 2 = 0) SELECT event_id, ts, event_type FROM e, w WHERE event_id % 2 = 0 OR ts > mark")
def distinct_within_delay(t):
    """Even events land, twice; then all. Of the odd ones those come too late that are older than the watermark: two days before the latest even one."""
    e, at = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), folder(t("events"))
    even = e.filter("event_id % 2 = 0")
    for k, new in enumerate([even.union(even), e]):
        new.write.parquet(f"{at}/land/{k}")
        ingest.resumed(ingest.landing(e.sparkSession, f"{at}/land/*", e.schema), "event_id", f"{at}/out", f"{at}/state", "ts", "2 days")
    return e.sparkSession.read.schema(e.schema).parquet(f"{at}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT p_partkey FROM part WHERE p_size % 7 <> 0 AND p_size % 7 <> 3")
def skip_list(t):
    return C.without_index(t("part").withColumn("k", F.col("p_size") % 7), "k", [0, 3]).select("p_partkey")


@query("SELECT event_id, event_type AS kind FROM events WHERE event_id % 4 > 1")
def complete_pairs(t):
    """Rows with a null or an empty half go; columns are kept by a list and renamed."""
    e = t("events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("concepts"), F.when(F.col("event_id") % 4 == 1, "").otherwise(F.col("event_type")).alias("description"))
    return C.complete_rows(e, "concepts", "description").select("event_id", "concepts").withColumnsRenamed({"concepts": "kind"})


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def member_of_any(t):
    c = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    return C.in_any(t("orders"), "o_custkey", c.filter("c_nationkey = 3"), c.filter("c_mktsegment = 'BUILDING'")).select("o_orderkey")


@query(BASE + "SELECT p_partkey, (n + 2)::INT AS rows FROM p")
def prompt_to_grids(t):
    """A prompt is read back as grids; one that holds no colour word is dropped."""
    pair = F.struct(F.col("g").alias("input"), F.col("g").alias("output"))
    prompt = F.concat(X.problem_prompt(F.array(pair, pair), pair), F.lit("\n\nExample 9\nInput:\n???\n"))
    out = derived(dealt(t("part").select("p_partkey", "p_size"))).select("p_partkey", F.col("g"), X.prompt_pairs(prompt).alias("q"))
    whole = (F.get("q.train", 0)["output"] == F.col("g")) & (F.get("q.train", 1)["input"] == F.col("g")) & (F.col("q.test") == F.col("g"))
    return out.select("p_partkey", F.when(whole, F.size("q.train") + G.height(F.col("q.test"))).alias("rows"))
