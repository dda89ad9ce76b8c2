"""Token counts, Merkle manifest, vector codes: against the library or plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dqspark.llm import merkle, tokencounts, vectorcodes

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


# --- token counts -------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    whole = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    "", " ", "hello world", "it's we'll you've 'r 're ''s 'v x'l'l 'll'", "İstanbul ΟΔΟΣ café", "'", "'r", "l'",
    "<|endoftext|>a<|startoftext|> <|EndofText|><|endoftext|>", "a" * 5000, "ab" * 777 + "c" * 333, "12 3½ ٣ ⅷ", "日本語 한국어",
    "x̀́y'́s", "\x00\x1f\x85  z", "'" * 10 + "s", "'re" * 50, "-" * 3000, "🙂" * 700, "lowest lower",
]


def test_tokens_of_awkward_texts(library):
    assert tokencounts.counter(PATH).count(TEXTS).tolist() == library(TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdelrstv'm .!?01\n\té́ßİſΣς<|>endoftxstar日🙂", max_size=80), max_size=4))
def test_tokens_of_any_text(texts):
    whole = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_tokens_of_any_text, "w") else test_tokens_of_any_text.w
    test_tokens_of_any_text.w = whole
    want = [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokencounts.counter(PATH).count(texts).tolist() == want


def test_tokens_of_long_texts_and_pieces(library, monkeypatch):
    """Pieces, chunks inside words and a table that begins anew change nothing."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("inthanreor  \n'x") for _ in range(30_000)), "".join(rng.choice("inthanreor") for _ in range(20_000))]
    want = library(texts)
    assert tokencounts.counter(PATH).count(texts).tolist() == want
    monkeypatch.setattr(tokencounts, "PIECE", 997)
    monkeypatch.setattr(tokencounts, "STATES", 50)
    assert tokencounts.counter(PATH).count(texts).tolist() == want


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunk_maps_compose(chunk):
    """Marks do not depend on where chunks are cut."""
    rng = np.random.default_rng(chunk)
    classes = np.append(rng.integers(0, tokencounts.CLASSES, 500), tokencounts.END).astype(np.uint8)
    assert (tokencounts.word_starts(classes, chunk) == tokencounts.word_starts(classes, 10_000)).all()


def test_prefix_scan():
    rng = np.random.default_rng(5)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    got, whole = tokencounts.prefix_scan(maps), np.arange(8)
    for i in range(37):
        whole = maps[i][whole]
        assert (got[i] == whole).all()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokencounts.Counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_count_tokens_rows(spark, library):
    rows = [(1, "a b", "z"), (1, "a b", "z"), (None, None, None), (2, "", "q"), (3, "word " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokencounts.count_tokens(docs, PATH).collect()
    want = library([t or "" for _, t, _ in rows])
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [
        (i, len((t or "").encode()), n, n > 2048) for (i, t, _), n in zip(rows, want)
    ]
    assert tokencounts.count_tokens(docs.limit(0), PATH).collect() == []


# --- Merkle manifest ------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    """Root and the (left, right) siblings of every node, level by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p - p % 3
            proofs[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        at = [p // 3 for p in at]
        level = [_h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def _plain_manifest(rows):
    groups: dict = {}
    for r in rows:
        leaf = _h(*map(_field, (r[0], r[1], r[2], r[3], r[4])))
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf), r, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in sorted(groups[s], key=lambda x: x[0])]) for s in names]
    root, above = _tree([t[0] for t in trees])
    out = []
    for name, (sub, proofs), upper in zip(names, trees, above):
        for (_, r, leaf), proof in zip(sorted(groups[name], key=lambda x: x[0]), proofs):
            steps, h = proof + upper, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                h = _h(*map(_field, (r[0], r[1], r[2], r[3], r[4].replace("\n", ""))))
            for left, right in steps:
                h = _h(left, h, right)
            out.append((r[0], leaf, sub, root, _h(*(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string"


def _docs(sizes):
    rng = random.Random(str(sizes))
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            text = rng.choice([None, "", "a\nb", "é\n\n", "plain", "x" * 50])
            rows.append((i * 7 % 1009, source, rng.choice(["en", None]), rng.choice([None, -3, 12]), text, "t", "d"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 3}, {"a": 4, None: 1}, {None: 2, "": 10, "é": 28, "z": 1, "A": 9}, {f"s{i}": 1 + i % 5 for i in range(12)}],
)
def test_manifest_against_a_plain_version(spark, sizes):
    rows = _docs(sizes)
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == _plain_manifest(rows)


def test_manifest_repeated_rows_missing_ids_and_empty(spark):
    rows = [(None, "a", None, None, "x\n", "", ""), (5, "a", "en", 1, "t\n", "", "")] * 3 + [(5, "a", "en", 2, "u", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(docs).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == _plain_manifest(rows)
    assert merkle.manifest(docs.limit(0)).collect() == []


# --- vector codes -----------------------------------------------------------------


def _plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = []
    for r in kept:
        v = [int(np.floor(x * scale)) for x in r[1]]
        w = len(v) // parts
        cut.append([v[p * w : (p + 1) * w] for p in range(parts)])
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        after = []
        for p in range(parts):
            groups: dict = {}
            for c in cut:
                groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
            after.append([[sum(z) // len(z) for z in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])])
        books = after
    out, by_label = [], {}
    for r, c in zip(kept, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    data = rng.normal(0, 0.2, (n, dim)).astype(np.float32)
    data[n // 2 :] = data[: n - n // 2]  # copies
    rows = [(int(i), data[i].tolist(), [None, 1, 2][i % 3], "x") for i in range(n)]
    bad = [(n + 1, None, 1, "x"), (n + 2, [None] * dim, 1, "x"), (-1, [float("nan")] * dim, 1, "x"), (-2, [float("inf")] + [0.0] * (dim - 1), 2, "x")]
    return rows + bad + rows[:2]


@pytest.mark.parametrize("n,dim", [(120, 16), (40, 8), (9, 24), (1, 8)])
def test_codes_against_a_plain_version(spark, n, dim):
    rows = _vectors(n, dim, n)
    got = vectorcodes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got), key=repr) == _plain_codes(rows)


def test_codes_of_wide_components(spark):
    """Components whose squares exceed 64 bits are reckoned with wide integers."""
    rows = [(i, [float(2**70 if i == 3 else i)] + [0.5 * i] * 7, 1, "") for i in range(12)]
    got = vectorcodes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got), key=repr) == _plain_codes(rows)


def test_codes_of_empty_tables_and_other_lengths(spark):
    rows = [(1, [0.1] * 8, 1, ""), (2, [0.1] * 16, 1, ""), (3, [], None, "")]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vectorcodes.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: (None, None, 0), 3: (None, None, None)}
    assert vectorcodes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, [0.1] * 9, 1, "")], VECTORS))


def test_cells_keep_the_nearest_entry():
    """Pruning by boxes leaves what all distances give, ties to the lower entry, and evaluates less."""
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(c, 40, (300, 32)) for c in (-2000, 0, 1500)]).astype(np.int64)
    books = values[rng.permutation(900)[:16]].reshape(16, 8, 4).transpose(1, 0, 2).copy()
    books[:, 9] = books[:, 4]
    grid = vectorcodes.Grid(books)
    codes, error = grid.assign(values)
    d = ((values.reshape(-1, 8, 1, 4) - books[None]) ** 2).sum(3)
    assert (codes == d.argmin(2)).all() and (error == d.min(2)).all()
    assert grid.evaluated < 0.6 * grid.possible
    again, _ = grid.assign(values)
    assert (again == codes).all()
