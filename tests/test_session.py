from chunkloom.session import cut, shared_folder, small


def test_cut_uses_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = cut(spark.range(10).selectExpr("id * 2 AS v"))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() or df.count() == 10
    assert sorted(r.v for r in df.collect()) == list(range(0, 20, 2))


def test_small_only_marks_small_tables(spark):
    hint = lambda df: "Hint" in df._jdf.queryExecution().logical().toString() or "strategy=broadcast" in df._jdf.queryExecution().logical().toString()
    assert hint(small(spark.range(5))) and not hint(small(spark.range(5), rows=4))
