import pytest
from conftest import collected
from pyspark.sql import functions as F

from snapgate.operators.conform import Field, Reference, enrich, reference_flags, typed_projection
from snapgate.operators.joins import balanced_join, heavy_keys, will_be_broadcast
from snapgate.contracts import ContractError


@pytest.fixture(params=["-1", "10MB"], autouse=True)
def threshold(request, spark):
    """Every test once with sliced joins and once with broadcast parents."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_size_estimate_decides(spark, threshold):
    assert will_be_broadcast(spark.range(100)) == (threshold != "-1")
    assert not will_be_broadcast(spark.range(10_000_000))


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key, some are exact copies, some keys are NULL."""
    hot = spark.range(400).selectExpr("0 AS k", "id % 3 AS v")
    other = spark.range(600).selectExpr("CAST(1 + id % 50 AS INT) AS k", "id AS v")
    none = spark.range(200).selectExpr("CAST(NULL AS INT) AS k", "1 AS v")
    return hot.unionByName(other).unionByName(none)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("unique", [False, True])
def test_sliced_join_equals_plain_join(spark, skewed, how, unique):
    parent = spark.range(0, 60, 2).selectExpr("CAST(id AS INT) AS pk", "id * 10 AS w")
    plain = skewed.join(parent, skewed["k"] == parent["pk"], how).drop("pk")
    sliced = balanced_join(skewed, parent, [("k", "pk")], how, unique=unique, parts=30)
    assert plain.columns == sliced.columns
    assert collected(plain) == collected(sliced)


def test_keys_of_different_types(spark, skewed):
    """Equal numbers of different types have different hashes."""
    parent = spark.range(0, 60, 2).selectExpr("id AS pk", "'x' AS w")
    sliced = balanced_join(skewed, parent, [("k", "pk")], "inner", parts=30)
    assert sliced.count() == skewed.join(parent, skewed["k"] == parent["pk"]).count()


def test_heavy_keys_get_slices_by_share(spark, skewed):
    found = collected(heavy_keys(skewed, ["k"], 4).select("slices"))
    # 400 of 1,200 rows at 1,200 / 32 rows a slice; no other key fills one.
    assert found == [(11,)]
    assert heavy_keys(spark.range(0), ["id"]).count() == 0


def test_repeated_parents_multiply_as_in_a_plain_join(spark, skewed):
    parent = spark.range(6).selectExpr("CAST(id % 2 AS INT) AS pk", "id AS w")
    plain = skewed.join(parent, skewed["k"] == parent["pk"], "inner").drop("pk")
    assert collected(balanced_join(skewed, parent, [("k", "pk")], "inner", parts=30)) == collected(plain)


def task_rows(spark, df):
    """Rows that each task of the last shuffled stage reads, from the plan without AQE."""
    counted = df.withColumn("_task", F.spark_partition_id()).groupBy("_task").count()
    return sorted(r["count"] for r in counted.collect())


@pytest.mark.parametrize("key", ["IF(id % 10 < 9, 7, id)", "IF(id % 10 < 3, NULL, id % 5000)", "7", "IF(id % 3 = 0, 7, id % 40)"])
def test_no_task_has_twice_the_median(spark, key):
    """A key with 90 % of the rows, 30 % NULL keys, one key only, and one of few keys."""
    old = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        child = spark.range(0, 200_000, 1, 8).selectExpr("id", f"{key} AS k")
        parent = spark.range(0, 300_000, 2, 4).selectExpr("id AS pk")
        flagged = reference_flags(child, [Reference(parent, (("k", "pk"),), "found")])
        sizes = task_rows(spark, flagged)
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        looked = enrich(child, parent.selectExpr("pk AS k", "pk * 2 AS w"), ["k"], ["w"], "known")
        sizes = task_rows(spark, looked)
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        even = child.where("k % 2 = 0 AND k < 300000").count()
        assert flagged.where("found").count() == even == looked.where("w = 2 * k AND known").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_unread_flags_are_not_joined(spark, skewed):
    parent = spark.range(60).selectExpr("CAST(id AS INT) AS pk", "id AS w")
    flagged = reference_flags(skewed, [Reference(parent, (("k", "pk"),), "found")])
    looked = enrich(skewed, parent.selectExpr("pk AS k", "w"), ["k"], ["w"], "known")
    for df in (flagged.groupBy("v").count(), looked.groupBy("v").count()):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_keep_grain_and_are_never_null(rows):
    child = rows([("o1", "c1"), ("o1", "c1"), ("o2", None), ("o3", "x")], "order_id string, customer_id string")
    parent = rows([("c1",), ("c1",), (None,)], "customer_id string")
    flagged = reference_flags(child, [Reference(parent, (("customer_id", "customer_id"),), "found")])
    assert collected(flagged) == [
        ("o1", "c1", True), ("o1", "c1", True), ("o2", None, False), ("o3", "x", False)]
    assert flagged.columns == ["order_id", "customer_id", "found"]


def test_flags_with_equal_names_behind_a_projection(rows):
    """The parent derives its key from a column named like the child's key."""
    child = rows([("1",), ("2",), (None,)], "id string").selectExpr("upper(id) AS id")
    parent = rows([("1", "a"), ("2", None)], "id string, v string").selectExpr(
        "CAST(id AS STRING) AS id", "v").where("v IS NOT NULL")
    flagged = reference_flags(child, [Reference(parent, (("id", "id"),), "found")])
    assert flagged.agg(F.count_if("found"), F.count_if(~F.col("found"))).first() == (1, 2)


def test_composite_reference(rows):
    child = rows([(1, 1), (1, 2)], "a int, b int")
    parent = rows([(1, 2)], "x int, y int")
    flagged = reference_flags(child, [Reference(parent, (("a", "x"), ("b", "y")), "found")])
    assert collected(flagged) == [(1, 1, False), (1, 2, True)]


def test_enrich_is_deterministic_over_duplicate_keys(rows):
    lookup = rows([("k", "b"), ("k", "a"), ("z", "q")], "key string, value string")
    df = rows([("k", 1), ("m", 2), (None, 3)], "key string, n int")
    enriched = enrich(df, lookup, ["key"], ["value"], "known")
    assert collected(enriched.select("n", "value", "known")) == [
        (1, "a", True), (2, None, False), (3, None, False)]


def test_typed_projection_drops_extras_and_flags_failures(rows):
    df = rows([("1", "x", "q"), ("y", None, "q"), (None, "2.5", "q")], "a string, b string, c string")
    typed = typed_projection(df, [
        Field("a", "int", evidence="a"), Field("b", "decimal(4,1)", "amount")],
        combined_evidence="_bad")
    assert typed.columns == ["a", "amount", "_invalid_a", "_bad"]
    assert collected(typed.selectExpr("a", "CAST(amount AS STRING)", "_invalid_a", "_bad")) == sorted([
        (1, None, False, True), (None, None, True, True), (None, "2.5", False, False)], key=repr)
    with pytest.raises(ContractError):
        typed_projection(df, [Field("nope")])
