from filings.operators.bloom import Filter, possible


def test_filter_loses_no_key_and_passes_few_others(spark):
    members = spark.range(0, 5000).selectExpr("cast(id * 7 as string) AS key")
    rows = spark.range(0, 70_000).selectExpr("cast(id as string) AS key", "id")
    bloom = Filter(members, "key")
    passed = {r.id for r in bloom.possible(rows).collect()}
    others = {r.id for r in bloom.impossible(rows).collect()}
    assert passed.isdisjoint(others) and len(passed) + len(others) == 70_000
    true = set(range(0, 35_000, 7))
    assert true <= passed and len(passed - true) < 0.01 * 65_000
    assert "BroadcastHashJoin" in bloom.possible(rows)._jdf.queryExecution().toString()


def test_no_filter_beyond_its_bound_and_for_no_keys(spark):
    members, rows = spark.range(0, 100), spark.range(0, 1000)
    assert possible(rows, members, "id", most=1).count() == 1000
    assert Filter(members, "id", most=1).impossible(rows).count() == 0
    assert possible(rows, members.limit(0), "id").count() == 0


def test_null_keys_are_no_members(spark):
    rows = spark.createDataFrame([(None,), ("a",)], "key string")
    members = spark.createDataFrame([("a",)], "key string")
    assert [r.key for r in possible(rows, members, "key").collect()] == ["a"]
