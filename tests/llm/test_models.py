"""The two classifiers: probabilities, held-out accuracy, disguised words, odd rows."""

from __future__ import annotations

import collections
import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dqspark.llm import charmodel, quality, toxicity
from dqspark.llm.common import Words

SCHEMA = "doc_id long, text string, lang string, score string"


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    counts = np.floor(rng.exponential(0.6, 6**3) ** 2)
    counts[:6] = 0  # a context that was never seen
    p = charmodel.kneser_ney(counts, 3, 6)
    assert np.allclose(p.reshape(-1, 6).sum(1), 1) and (p > 0).all()
    assert np.allclose(charmodel.kneser_ney(np.zeros(6**3), 3, 6), 1 / 6)


def test_kneser_ney_by_hand():
    """Bigrams over two classes: discounts from counts of counts, continuation counts below."""
    counts = np.array([1.0, 2.0, 0.0, 1.0])  # aa 1, ab 2, ba 0, bb 1
    n1, n2 = 2, 1
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2.0
    low_counts = np.array([1.0, 2.0])  # distinct words before a and before b
    yl = 1 / (1 + 2)
    l1, l2 = 1 - 2 * yl * 1 / 1, 2.0
    low = (low_counts - [l1, l2]) / 3 + (l1 + l2) / 3 * 0.5
    want = [(1 - d1) / 3 + (d1 + d2) / 3 * low[0], (2 - d2) / 3 + (d1 + d2) / 3 * low[1], 0 + d1 * low[0], (1 - d1) + d1 * low[1]]
    assert np.allclose(charmodel.kneser_ney(counts, 2, 2), want)


def test_counts_are_whole(spark):
    texts = ["abcab", None, "", "zz", "é", "A B"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = charmodel.dense(charmodel.count_cells(df, quality.TABLE, 3, quality.CLASSES), quality.CLASSES**3)
    want = np.zeros_like(got)
    for t in texts:
        c = [0, 0, *quality.TABLE[np.frombuffer((t or "").encode(), np.uint8)]]
        for i in range(len(c) - 2):
            want[(c[i] * 40 + c[i + 1]) * 40 + c[i + 2]] += 1
    assert (got == want).sum() >= len(got) - 8  # rows that follow each other share breaks
    assert abs(got.sum() - want.sum()) <= 3 * len(texts)
    assert all(got[np.flatnonzero(want)] >= want[np.flatnonzero(want)])


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    right = [r["keep"] == bool(r["quality"]) for r in rows]
    assert sum(right) >= 0.95 * len(right)


def test_quality_odd_rows(spark):
    rows = [(1, "good words here and there", "en", None), (2, None, "en", None), (3, "", None, None), (4, "more good words", None, None), (None, "zz", "xx", None), (1, "good words here and there", "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = {(r["doc_id"], r["lang"]): r for r in quality.classify(docs, labels).collect()}
    assert got[1, "en"]["keep"] and got[2, "en"]["perplexity"] is None and not got[2, "en"]["keep"] and not got[3, None]["keep"]
    assert quality.classify(docs.where("false"), labels).collect() == []
    free = quality.classify(docs, labels.where("false")).collect()
    assert len(free) == 6 and all(r["keep"] == (r["perplexity"] is not None) for r in free)


def test_quality_finds_both_classes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    for kind in (0, 1):
        mine = [r["keep"] == bool(kind) for r in rows if r["quality"] == kind]
        assert sum(mine) >= 0.9 * len(mine), (kind, sum(mine), len(mine))


def test_quality_limit_is_held_out(spark):
    """Texts of the counts do not make the limit; it lies where both classes lose least."""
    rows = [("en", n / 100, True) for n in range(100, 200)] + [("en", n / 100, False) for n in range(190, 290)] + [("xx", 1.0, True), ("xx", 2.0, True)]
    judged = spark.createDataFrame(rows, "lang string, nats double, good boolean")
    got = {r["lang"]: r["limit"] for r in quality.limits(judged, 0.5).collect()}
    assert 1.89 <= got["en"] <= 1.99 and got["xx"] == pytest.approx(1.0)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", None) for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    assert {r["out"] for r in rows} == {True, False}
    seen = max(r["perplexity"] for r in rows if not r["out"])
    assert all(r["limit"] > seen for r in rows)


def plain_nats(text, trusted, model):
    """Nats of a byte by the formula, word for word; the model of characters spells what is left."""
    def spelled(upto, a, b):
        classes = [0, 0, 0, *quality.TABLE[np.frombuffer(upto, np.uint8)]]
        return sum(model[((classes[i] * 40 + classes[i + 1]) * 40 + classes[i + 2]) * 40 + classes[i + 3]] for i in range(a, b))

    pairs = collections.Counter(x for t in trusted for x in zip(["", *t.split()], t.split()))
    words = collections.Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == i for c in counts.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        return [0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) if n[i - 1] else 0.5 for i in range(1, 4)]

    high, low = discounts(pairs), discounts(words)
    total, before, at = 0.0, "", 0
    for m in re.finditer(r"\S+", text):
        w, end = m[0], len(text[: m.end()].encode())
        p = math.exp(-spelled(text.encode(), at, end)) * sum(low[min(c, 3)] for c in words.values()) / len(pairs)
        p += (words[w] - low[min(words[w], 3)]) / len(pairs)
        mine = {x: c for x, c in pairs.items() if x[0] == before}
        if mine:
            c = pairs[before, w]
            p = (c - high[min(c, 3)] + sum(high[min(c, 3)] for c in mine.values()) * p) / sum(mine.values())
        total, before, at = total - math.log(p), w, end
    return (total + spelled(text.encode(), at, len(text.encode()))) / len(text.encode())


@pytest.mark.parametrize("shard_bytes", [quality.SHARD_BYTES, 20])
def test_quality_counts_pairs_of_words(spark, shard_bytes):
    trusted = ["the cat saw the dog", "the dog saw the cat  and the bird", "a bird saw a cat", "的 猫 看 的 狗"]
    texts = [*trusted, "the the the the", "dog the saw", "zebra  saw the cat \n", " ", "的 狗 狗", "cat"]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate([*texts, None])], SCHEMA)
    known = docs.where(f"doc_id < {len(trusted)}")
    model = quality.train(known)
    pairs = quality.count_pairs(known)
    got = {r["doc_id"]: r["nats"] for r in quality.score(docs, model, pairs, shard_bytes=shard_bytes).collect()}
    assert got.pop(len(texts)) is None
    assert got == pytest.approx({i: plain_nats(t, trusted, model) for i, t in enumerate(texts)}, rel=1e-5)


def test_quality_counts_grow(spark):
    """What is gathered is not bounded by a table of fixed size."""
    sizes = [quality.count_pairs(spark.range(n).selectExpr("concat('w', id, ' v', id) AS text")).count() for n in (100, 1000)]
    assert sizes == [200, 2000]


def shuffle_bytes(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in dirs for f in Path(str(d)).rglob("shuffle_*.data") if f.exists())


def test_quality_leaves_little_on_disk(spark):
    """Questions go in rounds and their shuffle files with them: less stays than the texts themselves have."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffle_bytes(spark)
    rows = quality.classify(docs, labels)
    for _ in range(50):  # files are deleted in the background
        if shuffle_bytes(spark) - before < size / 2:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) - before < size / 2
    assert rows.count() == docs.count()


def test_hashes_by_sums():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé猫 \t\n") for _ in range(rng.randrange(200))) for _ in range(300)] + [None, "", " ", "x" * 50_000]
    words = Words(pa.array(texts))
    assert (words.hashes_by_sums() == words.hashes()).all()
    long = Words(pa.array(["a b " * 200_000]))  # beyond the powers that are kept
    assert (long.hashes_by_sums() == long.hashes()).all() and not len(Words(pa.array([None], pa.string())).hashes_by_sums())


def test_quality_rounds_agree(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["of", "the", "cat", "Hund", "猫", "x1"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(i, t, "en", None) for i, t in enumerate(texts)] + [(None, None, None, None), (None, "the cat", "en", None), (3, texts[3], "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = docs.where("doc_id < 20")
    model, pairs = quality.train(known), quality.count_pairs(known)
    want = collections.Counter(x for t in [*texts[:20], texts[3]] for x in zip(["", *t.split()], t.split()))
    assert sorted(r["n"] for r in pairs.collect()) == sorted(want.values())
    got = [
        sorted((str(r["doc_id"]), str(r["nats"])[:12]) for r in quality.score(docs, model, pairs, shard_bytes=b, rounds=n).collect())
        for b, n in ((10**9, 1), (100, 1), (100, 4))
    ]
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2]


BAD = ["blockhead", "nitwit", "dunce", "twerpish"]


def speech(rng, toxic, n=60):
    fine = ["lantern", "garden", "window", "river", "stone", "paper", "cloud", "market", "engine", "forest", "violin", "harbour", "ladder", "copper", "meadow", "pencil"]
    words = [rng.choice(fine) + rng.choice(["", "s", "ly", "er"]) for _ in range(n)]
    for _ in range(3 if toxic else 0):
        words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, i % 7 == 0), "en", "s") for i in range(1400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1400)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_held_out(spark, learned):
    docs, labels = learned
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert all(r["predicted"] == r["toxic"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_sees_through_disguise(spark, learned):
    docs, labels = learned
    model = toxicity.train(docs, labels)
    fine = speech(random.Random(3), False)
    hidden = ["bl0ckhe@d", "n1tw1t", "n i t w i t", "d.u.n.c.e", "duuuunce", "BL0CKHEAD", "tw3rpi$h"]
    rows = [(i, f"{fine} {w} {fine}", None, None) for i, w in enumerate(hidden)] + [(50, fine, None, None), (51, None, None, None), (52, "", None, None), (53, "!!! $$$ 100% of 2b", None, None)]
    test = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["s"] for r in test.select("doc_id", toxicity.score_column(test, model).alias("s")).collect()}
    assert all(got[i] >= 0.5 for i in range(len(hidden))), got
    assert all(got[i] < 0.5 for i in (50, 51, 52, 53))
    assert got[51] == got[52]


def test_toxicity_sees_words_among_others(spark, learned):
    """Long runs, long repeats and neighbours do not hide a word."""
    docs, labels = learned
    model = toxicity.train(docs, labels)
    fine = speech(random.Random(3), False, 8)
    sentence = "the garden river " + "window stone " * 4 + "nitwit lantern paper"
    hidden = [
        " ".join(sentence.replace(" ", "")), "garden,n1tw1t", "river.bl0ckhe@d", "d" + "u" * 130 + "nce", "window-" * 20 + "n1tw1t",
        "window" * 500 + ",n1tw1t", " ".join("window" * 300 + "nitwit"),
    ]
    rows = [(i, f"{fine} {w} {fine}", None, None) for i, w in enumerate(hidden)]
    rows += [(50, " ".join(sentence.replace("nitwit", "").replace(" ", "")), None, None), (51, "garden,r1ver", None, None)]
    test = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["s"] for r in test.select("doc_id", toxicity.score_column(test, model).alias("s")).collect()}
    assert all(got[i] >= 0.5 for i in range(len(hidden))), got
    assert got[50] < 0.5 and got[51] < 0.5


def test_letters_set_apart():
    """Letters of several bytes are letters; one-letter words before a spaced word part from it."""
    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [t.decode() for _, t in toxicity._suspects(data, np.array([0, len(data)]))]

    assert found("so é t é s") == ["é t é s"] and found("müüüde") == ["müüüde"] and found("d€nk a") == ["d€nk"]
    words = "a lantern you idiot garden a stone river you paper a cloud idiot a meadow you violin "
    counts = np.zeros(toxicity.CLASSES**4)
    classes = [0, 0, 0, *toxicity.TABLE[np.frombuffer((words * 20).encode(), np.uint8)]]
    for i in range(len(classes) - 3):
        counts[((classes[i] * 28 + classes[i + 1]) * 28 + classes[i + 2]) * 28 + classes[i + 3]] += 1
    channel = toxicity.Channel(-np.log(charmodel.kneser_ney(counts, 4, 28)))
    assert channel.decode("a i d i o t") == "a idiot"
    assert channel.decode("y o u i d i o t") == "you idiot"
    assert channel.decode("you,idi0t") == "you idiot"


def _best_reading(token, channel):
    """The cheapest of all readings, one after another."""
    import itertools

    cost, size = channel.cost, toxicity.CLASSES ** (toxicity.ORDER - 1)
    best = (float("inf"), "")
    for choice in itertools.product(*toxicity.lattice(token)):
        state, spent = 0, 0.0
        for letters, extra in choice:
            spent += extra
            for x in letters:
                cell = state * toxicity.CLASSES + (ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27)
                spent += cost[cell]
                state = cell % size
        best = min(best, (spent + cost[state * toxicity.CLASSES], "".join(w for w, _ in choice)))
    return best


def test_decoder_finds_the_cheapest_reading():
    """Against all readings of lattices with many options a symbol; no state may be given up on the way."""
    rng = np.random.default_rng(4)
    counts = np.zeros(toxicity.CLASSES**4)
    counts[rng.integers(0, len(counts), 60_000)] += rng.integers(1, 9, 60_000)
    channel = toxicity.Channel(-np.log(charmodel.kneser_ney(counts, 4, 28)))
    for _ in range(60):
        token = "".join(rng.choice(list("ab1170|$@+zz--5"), rng.integers(3, 9)))
        if sum(x is not toxicity.BREAK for x in toxicity.lattice(token)) < 3:
            continue
        least, text = _best_reading(token, channel)
        got = channel.decode(token)
        assert got == text or abs(least - _cost_of(got, token, channel)) < 1e-4


def _cost_of(text, token, channel):
    """The least cost at which a lattice reads as ``text``."""
    import itertools

    cost, size = channel.cost, toxicity.CLASSES ** (toxicity.ORDER - 1)
    best = float("inf")
    for choice in itertools.product(*toxicity.lattice(token)):
        if "".join(w for w, _ in choice) != text:
            continue
        state, spent = 0, sum(e for _, e in choice)
        for x in text:
            cell = state * toxicity.CLASSES + (ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27)
            spent += cost[cell]
            state = cell % size
        best = min(best, spent + cost[state * toxicity.CLASSES])
    return best


def test_signs_at_word_ends_are_suspects():
    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [t.decode() for _, t in toxicity._suspects(data, np.array([0, len(data)]))]

    assert found("you idio7 and") == ["idio7"] and found("idio+") == ["idio+"] and found("a$$ b") == ["a$$"]
    assert found("well done! yes") == []


def test_remembered_words_belong_to_one_model():
    rng = np.random.default_rng(1)
    for seed in range(3):
        counts = np.zeros(toxicity.CLASSES**4)
        counts[rng.integers(0, len(counts), 5000)] += 1 + seed
        channel = toxicity.Channel(-np.log(charmodel.kneser_ney(counts, 4, 28)))
        assert channel.decode("b4d") == channel._decode("b4d")
    assert list(toxicity._REMEMBERED.words) == ["b4d"]


def test_toxicity_odd_labels(spark, learned):
    docs, labels = learned
    few = docs.limit(5)
    for bad in (labels.where("false"), labels.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic"), labels.selectExpr("doc_id", "0 AS toxic")):
        assert all(r["predicted"] == 0 for r in toxicity.classify(few, bad).collect())
    assert toxicity.classify(docs.where("false"), labels).collect() == []


def test_toxicity_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("toxic = 0").collect()
    assert sum(r["predicted"] for r in rows) <= 0.02 * len(rows)


def test_toxicity_recall_on_held_out_rows(spark):
    """At a tenth of the scale: most toxic rows that were not learned from are found, hardly any other."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.classify(labelled, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert sum(toxic) >= 0.88 * len(toxic) and sum(clean) <= 0.01 * len(clean)
