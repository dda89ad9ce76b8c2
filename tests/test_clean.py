from __future__ import annotations

from dqspark.operators import clean


def column(df, name="c"):
    return [r[name] for r in df.collect()]


def strip(spark, values, finder=clean.find_prefixes, separator=False, **options):
    df = spark.createDataFrame([(v,) for v in values], "c string").coalesce(1)
    found = finder(df, **options)
    return column(clean.strip_prefixes(df, found, separator)), found


def test_separator_stays(spark):
    assert strip(spark, ["Gate-12", "Gate-13"])[0] == ["-12", "-13"]
    assert strip(spark, ["Gate-12", "Gate-13"], separator=True)[0] == ["12", "13"]


def test_no_remainder(spark):
    assert strip(spark, ["True", "True"])[0] == ["True", "True"]


def test_missing_values_count_in_the_share(spark):
    assert strip(spark, ["NATION_1", None]) == (["NATION_1", None], [])
    values, found = strip(spark, [f"NATION_{i}" for i in range(9)] + [None])
    assert values == [*map(str, range(9)), None]
    assert found[0].pct_rows == 90.0


def test_one_odd_token_hides_a_glued_prefix(spark):
    values = [f"Gate{i}" for i in range(20)] + ["x"]
    assert strip(spark, values)[1] == []


def test_low_threshold_takes_the_exact_mode(spark):
    values = ["aaa_1", "bbb_1", "bbb_2", "aaa_2", "zz"]
    got, found = strip(spark, values, threshold=0.4)
    assert found[0].prefix == "aaa_" and got == ["1", "bbb_1", "bbb_2", "2", "zz"]


def test_older_rules(spark):
    got, found = strip(spark, [f"Name_{i}" for i in range(19)] + ["Pilot_x"], clean.find_token_prefixes)
    assert found[0].prefix == "Name_" and found[0].pct_rows == 100.0 and got[-1] == "Pilot_x"
    assert strip(spark, ["Claimjlo", "Claimxyz", "claim"], clean.find_letter_prefixes)[1] == []
    assert strip(spark, ["Claimjlo", "Claimxyz"], clean.find_letter_prefixes)[0] == ["jlo", "xyz"]


def test_nothing_to_find(spark):
    assert strip(spark, [])[1] == []
    assert strip(spark, [None, None])[1] == []


def test_chain(spark):
    rows = [(" Gatezn ", "a  B"), (" Gatezn ", "a  B"), ("Gateqa", None), ("Gatexx", "  ")]
    df = spark.createDataFrame(rows, "g string, t string")
    done = clean.basic_clean(df)
    assert sorted(map(tuple, done.data.collect()), key=str) == [("Qa", None), ("Xx", None), ("Zn", "A B")]
    again = clean.clean_text(clean.set_case(done.data))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, done.data.collect()), key=str)
    report = {r["operation"]: r for r in done.report(spark).collect()}
    assert report["remove_duplicates"]["detail"] == "Removed 1 duplicate rows"
    assert report["strip_uniform_prefixes"]["detail"] == "gate"


def test_parts_can_be_left_out(spark):
    df = spark.createDataFrame([(" a ",), (" a ",)], "c string")
    done = clean.basic_clean(df, remove_duplicates=False, clean=False, case="none")
    assert column(done.data) == [" a ", " a "]
