"""The pipeline against plain versions of its stages; registered queries and the package's borders."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from dqspark.llm import secrets, toxicity
from dqspark.llm.queries import ORACLE, QUERIES
from tests.llm.test_texts import WORDS, plain_classes, plain_contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """A third of the small tables and awkward rows, in a directory of their own."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [
        (90001, None, None, None, None), (90002, "", "en", "src0", 0), (None, "no id here", "en", None, 10),
        (90003, "password = Zx81kkq0aaBB and more", "en", "src1", 32), (90003, "password = Zx81kkq0aaBB and more", "en", "src1", 32),
    ]
    odd = spark.createDataFrame(odd, docs.schema)
    docs.where("doc_id < 900").unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_stages_and_whole(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "decontamination", "secrets", "mixing"]
    bench = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]

    def step(name, df):
        out = stages[name](spark, df, tables)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    scores = toxicity.classify(docs, labels).collect()
    toxic = {r["doc_id"] for r in scores if r["predicted"]}
    one = step("toxicity", docs)
    assert one.columns == COLUMNS
    assert sorted(map(str, as_rows(one))) == sorted(str(r) for r in as_rows(docs) if r[0] not in toxic)

    two = step("ngram_jaccard", one)
    rows = as_rows(one)
    named = [r for r in rows if r[0] is not None]
    gone = {i for i, _, component, _ in plain_classes([(i, t) for i, t in named]) if i != component}
    assert two.columns == COLUMNS
    assert sorted(map(str, as_rows(two))) == sorted(str(r) for r in rows if r[0] not in gone)

    three = step("decontamination", two)
    bad = {r[0] for r in plain_contamination([(r[0] if r[0] is not None else -1, r[1]) for r in as_rows(two)], bench) if r[5]}
    assert three.columns == COLUMNS
    assert sorted(map(str, as_rows(three))) == sorted(str(r) for r in as_rows(two) if r[0] not in bad)

    four = step("secrets", three)
    assert four.columns == COLUMNS
    want = sorted(str((i, secrets.redact_text(t))) for i, t in as_rows(three))
    assert sorted(map(str, as_rows(four))) == want
    assert not any(secrets.base_spans(t or "") for _, t in as_rows(four))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in four.collect())

    five = step("mixing", four)
    sizes = [len(WORDS.findall(t or "")) for _, t in as_rows(four)]
    assert sum(r["taken"] for r in five.collect()) == pytest.approx(1.5 * sum(sizes), rel=0.02)
    whole = corpus_pipeline.run(spark, tables)
    assert sorted(map(str, whole.collect())) == sorted(map(str, five.collect()))


def test_stages_take_an_empty_table(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).collect() == []


def test_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(QUERIES) == set(names) and set(ORACLE) <= set(names)
    assert "pipeline" in entry.queries()


def test_nothing_else_imports_the_package():
    root = Path(entry.__file__).parent
    for path in [*root.glob("dqspark/**/*.py"), *root.glob("tests/*.py"), root / "bench.py", root / "check_queries.py"]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
