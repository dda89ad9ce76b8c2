"""Similarity join, substring deduplication, decontamination: against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from dqspark.llm import decontaminate, jaccard, substring

SCHEMA = "doc_id long, text string, n_words string, lang string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Random texts, exact and near copies, shared passages, repeated words, junk cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÄé9'") for _ in range(rng.randint(1, 6)))
    shared = [word() for _ in range(30)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not texts:
            words = [word() for _ in range(rng.randint(1, 90))]
        elif kind < 0.75:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(20)] + shared + [word() for _ in range(rng.randint(1, 20))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)
        texts.append(text)
        rows.append((i, text, "x", "en"))
    rows += [
        (900, None, None, None), (901, "", "", ""), (902, " \n\t ", "x", "en"), (903, "a b c", "x", "en"),
        (904, "A  b\nC", "x", "en"), (905, "go " * 3000, "x", "en"), (906, "go " * 2000, "x", "en"),
        (907, " ".join(f"w{i}" for i in range(20000)), "x", "en"), (908, "w1 w2 " + " ".join(f"w{i}" for i in range(19000)), "x", "en"),
        (909, "a b c d e f", "x", "en"),
    ]
    rng.shuffle(rows)
    return rows


def plain_classes(rows, n=5):
    sets = []
    for r in rows:
        w = WORDS.findall((r[1] or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                of[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[root(i)], links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [512, 3])
def test_jaccard(spark, tile):
    rows = corpus()
    got = jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()
    assert sorted(map(tuple, got)) == plain_classes(rows)


def test_jaccard_limit_is_exact(spark):
    """Overlap of exactly 0.8 links, a little less does not."""
    base = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(base), None, None), (2, " ".join(base[:-1] + ["z"]), None, None)]  # 8 of 10
    rows += [(3, " ".join(f"b{i}" for i in range(12)), None, None), (4, " ".join([f"b{i}" for i in range(11)] + ["z"]), None, None)]  # 7 of 9
    got = jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain_classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_jaccard_repeated_and_empty(spark):
    rows = [(5, "a b c d e f", None, None)] * 2 + [(6, "a b c d e f", None, None), (None, None, None, None)]
    got = sorted(map(tuple, jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(5, 2, 5, 2), (5, 2, 5, 2), (6, 2, 5, 2), (None, 0, None, 0)]
    assert jaccard.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_repeats(rows, window=13):
    first = {}
    docs = [(r[0], WORDS.findall(r[1] or "")) for r in rows]
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowded", [2000, 2])
def test_substring(spark, crowded):
    rows = corpus(5)
    found = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), crowded)
    got = sorted(map(tuple, substring.digest_rows(found).collect()))
    want = plain_repeats(rows)
    assert got == want
    assert sum(r[2] for r in want) > 100


def test_substring_edges(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, None, None), (1, text, None, None), (2, text, None, None), (None, text, None, None)]
    got = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 20), (99, 20)]
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_contamination(rows, items, window=10):
    tests = [(i, TERMS.findall((t or "").translate(LOW))) for i, t in items]
    wins = {}
    for i, w in tests:
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for r in rows:
        w = TERMS.findall((r[1] or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        names = ",".join(sorted(str(i) for i in found))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def benchmark(rows):
    long = [TERMS.findall(r[1].translate(LOW)) for r in rows if r[1] and len(r[1]) > 200]
    items = [(i, " ".join(w[4:30])) for i, w in enumerate(long[:8])]
    items += [(10, " ".join(w[2:9]).upper()) for w in long[3:4]]
    items += [(11, "go"), (12, None), (13, "..."), (14, "nowhere to be found"), (15, "go go go go go go go go go go go"), (7, items[2][1])]
    return items


def test_contamination(spark):
    rows = corpus(9)
    items = benchmark(rows)
    found = decontaminate.find_contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(map(tuple, decontaminate.digest_rows(found).collect()))
    want = plain_contamination(rows, items)
    assert got == want
    assert sum(r[5] for r in want) > 8


def test_contamination_by_shuffle(spark, monkeypatch):
    """Tables beyond the broadcast limits are joined by a shuffle, with the same result."""
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", 0)
    test_contamination(spark)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find_contamination(none, items).collect() == []
    rows = spark.createDataFrame([(1, "a b c", None, None), (1, "a b c", None, None), (None, "x a b c", None, None), (1, "c", None, None)], SCHEMA)
    got = decontaminate.digest_rows(decontaminate.find_contamination(rows, items)).collect()
    assert sorted((r["n_words"], r["n_hit"]) for r in got) == [(1, 0), (3, 3), (3, 3), (4, 3)]
    got = decontaminate.find_contamination(rows, items.where("false")).collect()
    assert [r["n_hit"] for r in got] == [0, 0, 0, 0]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "blue x x x x red"), (3, "red red"), (4, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "Red blue")], "phrase_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, phrases, 4).collect()} == {1}
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, phrases, 6).collect()} == {1, 2}
