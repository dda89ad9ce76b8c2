"""More rules than a bigint has bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import flags, wideflags
from dqspark.operators.rules import Rule


def test_many_rules(spark):
    df = spark.range(150).withColumn("name", F.concat(F.lit("n"), "id"))
    rules = [Rule(f"id = {i} OR id = 149", ("id",), f"r{i}") for i in range(130)]
    rules[70] = Rule("no_such_function(id)", ("id",), "bad")
    run = wideflags.flag_rows_wide(df, rules)
    got = {r["id"]: r for r in run.data.select("id", "flag_words", wideflags.positions(F.col("flag_words")).alias("p"),
           wideflags.binary_text(F.col("flag_words")).alias("b"), wideflags.flags_text(F.col("flag_words"), 130).alias("t")).collect()}
    assert got[5]["p"] == [5] and got[62]["p"] == [62] and got[63]["p"] == [63] and got[129]["p"] == [129] and got[140]["p"] == []
    assert got[149]["p"] == [i for i in range(130) if i != 70] and got[70]["p"] == []
    assert got[129]["t"] == f"Flags: {1 << 129}" and got[140]["t"] == "No flags"
    assert all(int(r["b"], 2) == sum(1 << p for p in r["p"]) for r in got.values())
    results = {r["position"]: r for r in run.rule_results().collect()}
    assert len(results) == 130 and results[70]["success"] is False and results[70]["error"]
    assert all(results[i]["rows_detected"] == 2 and results[i]["success"] for i in range(130) if i != 70)
    rows = wideflags.decoded(run.data, run.issues(), ["id"]).where("id = 129").collect()
    assert [(r["position"], r["flag_value"], r["description"]) for r in rows] == [(129, str(1 << 129), "r129")]
    combos = {tuple(r["positions"]): r["row_count"] for r in wideflags.flag_combinations(run.data, 130).collect()}
    assert len(combos) == 130 and combos[(5,)] == 1
    every = run.data.agg(wideflags.merged("flag_words", 130).alias("w")).select(wideflags.count_flags(F.col("w"))).first()[0]
    assert every == 129


def test_one_word_is_the_usual_status(spark):
    df = spark.range(20)
    rules = [Rule(f"id % {i + 2} = 0", ("id",), f"r{i}") for i in range(8)]
    wide = wideflags.flag_rows_wide(df, rules).data.select("id", F.get("flag_words", F.lit(0)).alias("w"))
    one = flags.flag_rows(df, rules).data
    assert {tuple(r) for r in wide.collect()} == {(r["id"], r["flag_status"]) for r in one.collect()}
    assert wideflags.flag_rows_wide(df, []).data.where(wideflags.is_flagged(F.col("flag_words"))).count() == 0
