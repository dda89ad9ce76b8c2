from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dqspark.operators import clean, impute, rules
from dqspark.operators.flags import flag_rows, issue_table
from dqspark.operators.joins import JoinSpec
from dqspark.plans.cleaning import prepare
from dqspark.plans.quality import check, look_at
from dqspark.sources import readers, sinks
from dqspark.streaming.rows import clean_stream, write_stream


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_csv_types_and_missing(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,f,b,t,d,e\n1,1.5,True,"a ""x"", y",5d,\n2,NA,False,N/A,6,\n,3,true,nan,7,NULL\n')
    df = readers.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "d": "string", "e": "string"}
    rows = df.collect()
    assert rows[0]["t"] == 'a "x", y' and rows[1]["f"] is None and rows[1]["t"] is None and rows[2]["i"] is None
    typed = readers.read_csv(spark, str(path), "i int, f double, b boolean, t string, d double, e string")
    assert dict(typed.dtypes)["i"] == "int" and typed.first()["d"] == 5.0


def test_empty_table_is_refused(spark):
    with pytest.raises(ValueError):
        readers.require_rows(spark.range(0))


def test_rules_and_issues_come_back(spark, folder):
    used = [rules.negative("a"), rules.count_mismatch("a", "b"), rules.unusual_text("b")]
    sinks.write_rules(spark, used, f"{folder}/rules")
    again = readers.read_rules(spark, f"{folder}/rules")
    assert [r.detection_code for r in again] == [r.detection_code for r in used]
    assert [r.flag_value for r in again] == [1, 2, 4]
    issues = issue_table(spark, [{"description": "x"}, {}])
    sinks.write_issues(issues, f"{folder}/issues")
    assert readers.read_issues(spark, f"{folder}/issues/flags").count() == 2
    assert spark.read.json(f"{folder}/issues/metadata").first()["max_combined_value"] == 3
    spark.createDataFrame([(1,)], "flag_value int").write.json(f"{folder}/bare")
    bare = readers.read_issues(spark, f"{folder}/bare").first()
    assert (bare["category"], bare["severity"], bare["affected_columns"]) == ("unknown", "medium", [])


def test_whole_way(spark, sf_dir, folder):
    tables = readers.read_tables(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("customer", "nation")})
    done = prepare(tables, "customer", [JoinSpec("nation", "c_nationkey", "n_nationkey")], store=f"{folder}/cleaned")
    assert {p.column: p.prefix for p in done.cleaned.prefixes} == {"c_name": "customer", "n_name": "NATION_"}
    assert set(done.stages()) == {"Original", "Phase 1 (Cleaned)"}
    seen = look_at(done.data, ["c_custkey"], 50)
    assert seen["sample"].count() <= 50 and seen["column_info"].count() == len(done.data.columns)
    checked = check(done.data, renames={"c_acctbal": "balance", "c_name": "Use clear names"})
    assert "balance" in checked.run.data.columns and "c_name" in checked.run.data.columns
    written = checked.export(f"{folder}/out")
    assert spark.read.parquet(written["flagged_data"]).count() == 150
    assert spark.read.json(written["execution_summary"]).first()["total_rows"] == 150


def test_stream_equals_batch(spark, sf_dir, folder):
    batch = spark.read.parquet(f"{sf_dir}/customer.parquet")
    prefixes = clean.find_prefixes(batch)
    fill = impute.fit(batch, {"c_acctbal": "median"})
    used = [rules.negative("c_acctbal"), rules.unusual_text("c_mktsegment")]
    source = f"{folder}/in"
    batch.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    rows = clean_stream(stream, prefixes, "title", fill, used)
    query = write_stream(rows, f"{folder}/out", f"{folder.strip('/').replace('/', '_')}")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out")
    whole = clean.set_case(clean.strip_prefixes(clean.clean_text(batch), prefixes), "title")
    want = flag_rows(whole, used).data
    assert got.count() == 150 and got.exceptAll(want).count() == 0
    assert got.where("flag_status & 1 <> 0").count() == batch.where(F.col("c_acctbal") < 0).count()


def test_ordered_fill_is_refused_on_a_stream(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "i int, v double")
    fill = impute.fit(df, {"v": "forward_fill"}, order_by=["i"])
    with pytest.raises(ValueError):
        clean_stream(df, fill=fill)
