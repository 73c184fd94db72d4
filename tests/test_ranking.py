import random

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import ranking as rk
from tallyscope.operators.ordering import ordinal, value_ranks
from tallyscope.operators.quality import DataViolation

C = rk.Criterion


def rows(spark, data):
    return spark.createDataFrame(data, "id string, x double, y double")


def ranked(spark, data, criteria, policy, **more):
    result = rk.rank_entities(rows(spark, data), "id", criteria, policy, **more)
    return result.ranked.orderBy(*rk.rank_order("id")).collect(), result


def test_ties(spark):
    got, _ = ranked(spark, [("B", 10.0, None), ("A", 10.0, None), ("C", 5.0, None)], [C("x", "higher", 3.0)], "worst")
    assert [(r["id"], r["x_rank"], r["x_score"]) for r in got] == [("A", 1.5, 75.0), ("B", 1.5, 75.0), ("C", 3.0, 0.0)]


def test_missing_policies(spark):
    data = [("A", 10.0, 5.0), ("B", 20.0, None)]
    criteria = [C("x", "higher", 1.0), C("y", "higher", 1.0)]
    got, result = ranked(spark, data, criteria, "exclude")
    assert [(r["id"], r["composite_score"]) for r in got] == [("A", 100.0)]
    assert [(r["id"], r["missing_metrics"]) for r in result.excluded.collect()] == [("B", ["y"])]
    assert rk.rank_counts(rows(spark, data), result).first().asDict() == {"input_count": 2, "eligible_count": 1, "returned_count": 1}
    got, _ = ranked(spark, data, criteria, "worst")
    assert {r["id"]: (r["y_score"], r["y_rank"], r["composite_score"]) for r in got} == {"A": (100.0, 1.0, 50.0), "B": (0.0, None, 50.0)}
    got, _ = ranked(spark, data, criteria, "neutral")
    assert [(r["id"], r["composite_score"]) for r in got] == [("B", 75.0), ("A", 50.0)]
    got, _ = ranked(spark, data, criteria, "neutral", top_n=1)
    assert [r["id"] for r in got] == ["B"]


def brute(data, criteria, policy):
    live = [r for r in data if policy != "exclude" or None not in r[1:]]
    total = sum(c.weight for c in criteria)
    composite = {r[0]: 0.0 for r in live}
    for i, c in enumerate(criteria, start=1):
        values = sorted((r[i] for r in live if r[i] is not None), reverse=c.direction == "higher")
        for r in live:
            if r[i] is None:
                score = 0.0 if policy == "worst" else 50.0
            else:
                first = values.index(r[i]) + 1
                rank = (2 * first + values.count(r[i]) - 1) / 2
                n = len(values)
                score = 100.0 if n == 1 else 100.0 * (n - rank) / (n - 1)
            composite[r[0]] += score * (c.weight / total)
    return composite


@pytest.mark.parametrize("policy", rk.MISSING_POLICIES)
def test_against_brute_force(spark, policy):
    rng = random.Random(11)
    data = [
        (f"e{i:03d}", rng.choice([None, 1.0, 1.0, 2.0, rng.random() * 9]), rng.choice([None, -0.0, 0.0, rng.gauss(0, 3)]))
        for i in range(300)
    ]
    criteria = [C("x", "higher", 0.7), C("y", "lower", 0.0), ] if policy == "neutral" else [C("x", "higher", 0.7), C("y", "lower", 0.3)]
    result = rk.rank_entities(rows(spark, data).repartition(9), "id", criteria, policy)
    got = {r["id"]: r["composite_score"] for r in result.ranked.collect()}
    assert got == pytest.approx(brute(data, criteria, policy), abs=1.1e-6)


def test_groups_and_blocks(spark):
    big = spark.range(20_000).select(
        (F.col("id") % 7).alias("g"),
        F.lit("m").alias("metric"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") * 7919 % 5003).cast("double")).alias("v"),
    )
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("v")
    expected = big.select("g", "v", (F.rank().over(w) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2.0).alias("e")).distinct()
    got = value_ranks(big, ["g"], "metric", "v")
    assert got.join(expected, ["g", "v"]).where("abs(average_rank - e) > 1e-9").count() == 0 and got.count() == expected.count()
    keyed = big.withColumn("id", F.monotonically_increasing_id())
    numbered = ordinal(keyed, [F.col("v"), F.col("id")], "n", keys=["g"])
    plain = keyed.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert numbered.join(plain, ["g", "id"]).where("n <> p").count() == 0 and numbered.count() == 20_000


def test_arguments(spark):
    df = rows(spark, [("A", 1.0, 1.0)])
    for criteria in ([], [C("x", "up", 1.0)], [C("x", "higher", -1.0)], [C("x", "higher", 0.0)], [C("x", "higher", 1.0)] * 2, [C("x", "higher", float("nan"))], [C("x", "higher", True)]):
        with pytest.raises(ValueError):
            rk.rank_entities(df, "id", criteria, "worst")
    with pytest.raises(ValueError):
        rk.rank_entities(df, "id", [C("x", "higher", 1.0)], "best")
    with pytest.raises(ValueError):
        rk.rank_entities(df, "id", [C("x", "higher", 1.0)], "worst", top_n=0)
    twice = rows(spark, [("A", 1.0, 1.0), ("A", 2.0, 1.0)])
    with pytest.raises(DataViolation, match="duplicate"):
        rk.check_rank_input(twice, "id", [C("x", "higher", 1.0)])
    with pytest.raises(DataViolation, match="finite"):
        rk.check_rank_input(rows(spark, [("A", float("nan"), 1.0)]), "id", [C("x", "higher", 1.0)])
    assert rk.normalized_weights([C("x", "higher", 3.0), C("y", "lower", 1.0)]) == {"x": 0.75, "y": 0.25}


def test_null_group_and_rejects(spark):
    data = [(None, "a", 1.0), (None, "b", 3.0), ("g", "a", 5.0), ("g", "c", float("nan")), ("g", " ", 1.0), (None, "d", 2.0), ("g", "e", 7.0), ("g", "e", 9.0)]
    df = spark.createDataFrame(data, "g string, id string, x double")
    result = rk.rank_entities(df, "id", [C("x", "higher", 1.0)], "worst", by=["g"])
    got = {(r["g"], r["id"]): (r["x_rank"], r["composite_score"]) for r in result.ranked.collect()}
    assert got == {(None, "b"): (1.0, 100.0), (None, "d"): (2.0, 50.0), (None, "a"): (3.0, 0.0), ("g", "a"): (1.0, 100.0)}
    reasons = sorted((r["id"], r["reason"]) for r in result.rejected.collect())
    assert reasons == [
        (" ", "row id must be a non-empty string"),
        ("c", "ranking metrics must be finite"),
        ("e", "duplicate row id"),
        ("e", "duplicate row id"),
    ]
    counts = {r["g"]: (r["input_count"], r["eligible_count"]) for r in rk.rank_counts(df, result, ["g"]).collect()}
    assert counts == {None: (3, 3), "g": (5, 1)}


def test_a_third_of_the_rows_on_one_value(spark):
    df = spark.range(900).select(F.lit("k").alias("k"), F.lit("m").alias("m"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id")).cast("double").alias("v"))
    values = [50.0 if i % 3 == 0 else float(i) for i in range(900)]
    ordered = sorted(values)
    got = {r["v"]: r["average_rank"] for r in value_ranks(df, ["k"], "m", "v").collect()}
    assert got == {v: (2 * ordered.index(v) + values.count(v) + 1) / 2 for v in set(values)}


def test_cells_stay_spread(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).cast("double").alias("x"))
    ranked = rk.rank_entities(df, "id", [C("x", "higher", 1.0)], "worst").ranked
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # Neither a sort of all cells before they are aggregated, nor one task of the five values that takes them all.
    assert "SortAggregate" not in plan and "BuildLeft" not in plan
    assert ranked.count() == 4000 and {r["x_rank"] for r in ranked.collect()} == {400.5, 1200.5, 2000.5, 2800.5, 3600.5}
