"""Properties that hold for any input; each example set runs as one table."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dqspark.functions import flagbits, text

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
printable = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12)


@few
@given(values=st.lists(printable, min_size=1, max_size=30))
def test_cleaning_twice_is_cleaning_once(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    once = text.clean_space(F.col("c"))
    rows = df.select("c", once.alias("one"), text.clean_space(once).alias("two")).collect()
    assert all(r["one"] == r["two"] for r in rows)
    assert all(r["one"] == " ".join(r["c"].split()) for r in rows)


@few
@given(values=st.lists(st.integers(0, 2**63 - 1), min_size=1, max_size=30))
def test_flags_add_up_to_the_status(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s bigint")
    for r in df.select("s", flagbits.set_flags(F.col("s")).alias("f")).collect():
        assert sum(r["f"]) == r["s"] and r["f"] == sorted(set(r["f"]))


@few
@given(values=st.lists(st.text("ab ;,|>-\t", max_size=12), min_size=1, max_size=30))
def test_items_are_the_non_blank_parts(spark, values):
    import re

    df = spark.createDataFrame([(v,) for v in values], "c string")
    for r in df.select("c", text.item_count(F.col("c")).alias("n")).collect():
        assert r["n"] == sum(1 for part in re.split("[;,|>]|->", r["c"]) if part.strip())
