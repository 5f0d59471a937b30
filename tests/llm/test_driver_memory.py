import tracemalloc

from brute import table
from pyspark.sql import functions as F

from gridloom.llm import common, language


def test_learning_holds_little_more_than_the_matrix(spark):
    rows = [(i, f"{'this is text' if i % 2 else 'dies ist ein satz'} number {i * 7919}") for i in range(600)]
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    tracemalloc.start()
    try:
        model = language.learn(docs, F.lit(True))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.families and peak < 3 * len(rows) * language.FEATURES * 4


def test_the_driver_keeps_short_texts_of_plans(spark):
    df = spark.range(10)
    for k in range(40):
        df = df.join(spark.range(10).withColumnRenamed("id", f"k{k}"), F.col("id") == F.col(f"k{k}"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    common.written(df, "many-joins")
    assert spark.conf.get("spark.sql.maxPlanStringLength") != str(common.PLAN_TEXT)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = store.executionsList()
    assert plans.size() > before
    assert max(len(plans.apply(k).physicalPlanDescription()) for k in range(before, plans.size())) <= common.PLAN_TEXT + 100


def test_joins_of_held_tables_have_no_bloom_filters(spark, tmp_path):
    spark.range(2000).withColumn("x", F.col("id") % 7).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    with common.settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"), common.held(spark) as keep:
        several = t
        for c in "abc":
            several = several.join(t.select("id", F.col("x").alias(c)), "id")
        joined = keep(several).join(t.filter("x = 3").select("id"), "id")
        assert "might_contain" not in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == 286
