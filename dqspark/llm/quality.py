"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Units are words, the order is 2.  Pairs of words of the trusted texts are counted
in buckets of their hashes; the tables of pairs and words grow with the corpus and
stay distributed.  Documents are dealt to shards.  A shard asks each bucket for its
distinct words and pairs, as one sorted array, and the counts come back in the same
order, so that nothing but the counts travels back; they are summed per document.
Shards take turns in rounds, so that the disk holds the questions of one round only.
Below the words lies a model of characters (40 classes of bytes, order 4), which
spells words that no trusted text holds.
Perplexities are per byte.  Those of trusted documents that were held out of the
counts give each language its limit: the quantile at which the shares of good
documents lost and of bad ones kept are least together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.charmodel import codes, count_cells, dense, kneser_ney, padded, raw
from dqspark.llm.common import Words, brief_shuffles, mix, small_batches, steps, store

ORDER = 4
CLASSES = 40
#: Share of held-out trusted documents at or below the limit, where too few bad ones are known to choose it.
QUANTILE = 0.95
#: Labelled rows of either kind that a language's own choice needs.
LEAST_ROWS = 20
#: Fineness of the histogram the quantiles are read from, in nats.
STEP = 0.001
BROADCAST_IDS = 500_000
#: Bytes of text in a shard, about.
SHARD_BYTES = 8_000_000
#: Turns that the shards take; all documents are scored, a part of them in each.
ROUNDS = 6
#: Bytes of text whose pairs make a bucket of the counts, about.
BUCKET_BYTES = 2_000_000
#: Words whose pairs a task combines before it hands them on.
COUNT_WORDS = 2_000_000
#: Bytes of text that are hashed at a time, so that what that takes stays in the processor's cache.
STEP_BYTES = 500_000

_BEGIN = np.uint64(0x5851F42D4C957F2D)
_TURN = np.uint64(0xD1342543DE82EF95)


def _table() -> np.ndarray:
    """Class of each byte: blanks, small letters, capitals, digits, point, comma, other signs, eight of other bytes."""
    out = np.full(256, 31, np.int64)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[97:123] = np.arange(1, 27)
    out[65:91] = 27
    out[48:58] = 28
    out[ord(".")], out[ord(",")] = 29, 30
    out[128:] = 32 + (np.arange(128, 256) & 7)
    return out


TABLE = _table()


def train(trusted: DataFrame, order: int = ORDER) -> np.ndarray:
    """Negative log probabilities of all cells from every text of ``trusted``."""
    counts = dense(count_cells(trusted, TABLE, order, CLASSES), CLASSES**order)
    return (-np.log(kneser_ney(counts, order, CLASSES))).astype(np.float32)


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word the hash of the one before it, its own, and that of both; texts begin behind a mark."""
    own = words.hashes_by_sums()
    before = np.concatenate(([_BEGIN], own[:-1])) if len(own) else own
    before[words.row_first[:-1][words.per_row > 0]] = _BEGIN
    return before, own, mix(before * _TURN + own)


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _buckets(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the buckets among sorted hashes, by their upper half; and the buckets that are not empty."""
    at = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    bounds = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
    return bounds, np.flatnonzero(np.diff(bounds))


def _text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The arrays of a column of binaries, one behind another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _planes(grams: np.ndarray) -> bytes:
    """First bytes of all, second bytes of all, ...: those of sorted hashes that change little take little room."""
    return grams.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


PACKED = "bucket long, context binary, word binary, n binary"


def _row(bucket: int, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row of pairs that are in order of their contexts, as equal ones side by side take less room."""
    columns = [pa.array([bucket], pa.int64()), *(pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((context, np.uint64), (word, np.uint64), (n, np.int64)))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "context", "word", "n"])


def pack_counts(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES, size: int | None = None) -> DataFrame:
    """Every pair of words of ``texts`` (text) that occurs, with its count: arrays of pairs, a row for each bucket of hashes.

    ``size`` is the number of bytes of all texts, if it is known.
    """
    buckets = max(1, -(-(_text_bytes(texts) if size is None else size) // bucket_bytes))

    def packed(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        before, own, both = (np.concatenate(x) for x in zip(*found))
        grams, place = _sorted(both)
        first = np.empty(len(grams), np.int64)
        first[place] = np.arange(len(both))
        n = np.bincount(place, minlength=len(grams))
        bounds, some = _buckets(grams, buckets)
        for i in some:
            at = first[bounds[i] : bounds[i + 1]]
            order = np.argsort(before[at], kind="stable")
            yield _row(i, before[at][order], own[at][order], n[bounds[i] : bounds[i + 1]][order])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for batch in steps(parts, size=STEP_BYTES):
            found.append(_pairs(Words(batch.column("text"))))
            if sum(len(x[0]) for x in found) >= COUNT_WORDS:
                yield from packed(found)
                found = []
        if found:
            yield from packed(found)

    def merge(table: pa.Table) -> pa.Table:
        before, own = (_joined(table[c], np.uint64) for c in ("context", "word"))
        order = np.lexsort((own, before))
        before, own, n = before[order], own[order], _joined(table["n"], np.int64)[order]
        new = np.ones(len(n), bool)
        new[1:] = (before[1:] != before[:-1]) | (own[1:] != own[:-1])
        return pa.Table.from_batches([_row(table["bucket"][0].as_py(), before[new], own[new], np.add.reduceat(n, np.flatnonzero(new)))])

    return texts.select("text").mapInArrow(run, PACKED).groupBy("bucket").applyInArrow(merge, PACKED)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for row in zip(*(batch.column(c).to_pylist() for c in ("context", "word", "n"))):
        yield tuple(np.frombuffer(x, k) for x, k in zip(row, (np.uint64, np.uint64, np.int64)))


def count_pairs(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(context, word, n) of every pair of words of ``texts`` (text) that occurs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for context, word, n in _unpacked(batch):
                yield pa.RecordBatch.from_arrays([context.view(np.int64), word.view(np.int64), n], names=["context", "word", "n"])

    return pack_counts(texts, bucket_bytes).mapInArrow(run, "context long, word long, n long")


def _packed_rows(pairs: DataFrame) -> DataFrame:
    """Rows of pairs as ``pack_counts`` gives them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            context, word, n = (batch.column(c).to_numpy() for c in ("context", "word", "n"))
            order = np.argsort(context)
            yield _row(0, context[order].view(np.uint64), word[order].view(np.uint64), n[order])

    return pairs.select("context", "word", "n").mapInArrow(run, PACKED)


def _few_counts(pairs: DataFrame) -> DataFrame:
    """(n, count): how many pairs occur once, twice, three and four times."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for *_, n in _unpacked(batch):
                found = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
                yield pa.RecordBatch.from_arrays([np.arange(1, 5), found], names=["n", "count"])

    return pairs.mapInArrow(run, "n long, count long").groupBy("n").agg(F.sum("count").alias("count"))


def _word_counts(pairs: DataFrame) -> DataFrame:
    """(gram, n, total, one, two, more) of every word: pairs it ends, occurrences as a context, pairs it begins by their count."""
    names = ["gram", "n", "total", "one", "two", "more"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for context, word, n in _unpacked(batch):
                grams, place = _sorted(np.concatenate((context, word)))
                begins, ends = place[: len(n)], place[len(n) :]
                total = np.zeros(len(grams), np.int64)
                np.add.at(total, begins, n)
                kinds = [np.bincount(begins[x], minlength=len(grams)) for x in (n == 1, n == 2, n > 2)]
                columns = [grams.view(np.int64), np.bincount(ends, minlength=len(grams)), total, *kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    found = pairs.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts (n, count)."""
    few = {r["n"]: float(r["count"]) for r in counts.collect()}
    n = [few.get(i, 0.0) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.5 for i in range(1, 4)]


def facts_of(pairs: DataFrame, off: list[float]) -> tuple[DataFrame, float]:
    """(gram, part, total, spare) of every word, and the share left to the model of characters.

    A word's ``part`` is its share by distinct words before it; ``total`` and ``spare``
    are what it counts as a context and the share it leaves to the words alone; total
    is 0 if it is none.
    """
    words = store(_word_counts(pairs))
    low = _discounts(words.where("n BETWEEN 1 AND 4").groupBy("n").count())
    less = F.when(F.col("n") == 1, low[0]).when(F.col("n") == 2, low[1]).otherwise(low[2])
    sums = words.where("n > 0").agg(F.sum("n").alias("n"), F.sum(less).alias("off")).first()
    left = F.col("one") * off[0] + F.col("two") * off[1] + F.col("more") * off[2]
    facts = words.select(
        "gram", F.when(F.col("n") > 0, (F.col("n") - less) / float(sums["n"] or 1)).otherwise(0.0).alias("part"),
        F.col("total").cast("double").alias("total"), F.when(F.col("total") > 0, left / F.col("total")).otherwise(1.0).alias("spare"),
    )
    return facts, (sums["off"] / sums["n"] if sums["n"] else 1.0)


def _packed_pairs(pairs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, grams, facts): sorted hashes of pairs and their counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for context, word, n in _unpacked(batch):
                yield _packed(mix(context * _TURN + word), [n.astype(np.float64)], buckets, 0)

    return pairs.mapInArrow(run, "bucket long, grams binary, facts binary")


def _packed_words(facts: DataFrame, buckets: int) -> DataFrame:
    """The same of words, in buckets of their own; three facts each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            known = [batch.column(c).to_numpy() for c in ("part", "total", "spare")]
            yield _packed(batch.column("gram").to_numpy().view(np.uint64), known, buckets, buckets)

    return facts.mapInArrow(run, "bucket long, grams binary, facts binary")


def _packed(grams: np.ndarray, facts: list[np.ndarray], buckets: int, first: int) -> pa.RecordBatch:
    order = np.argsort(grams)
    grams, known = grams[order], np.stack([x[order] for x in facts], 1)
    bounds, some = _buckets(grams, buckets)
    cut = [slice(bounds[i], bounds[i + 1]) for i in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(some + first, pa.int64()), pa.array([_planes(grams[c]) for c in cut], pa.binary()), pa.array([known[c].tobytes() for c in cut], pa.binary())],
        names=["bucket", "grams", "facts"],
    )


def score(docs: DataFrame, model: np.ndarray, pairs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, lang, nats) of every row by the counts ``pairs`` (context, word, n), see ``score_packed``."""
    return score_packed(docs, model, store(_packed_rows(pairs)), order, shard_bytes, rounds)


def score_packed(
    docs: DataFrame, model: np.ndarray, pairs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES, rounds: int = ROUNDS, size: int | None = None
) -> DataFrame:
    """(doc_id, lang, nats) of every row: mean negative log probability of a byte, null without text.

    ``pairs`` are stored counts as ``pack_counts`` gives them; ``size`` is the number of
    bytes of all texts, if it is known.
    """
    spark = docs.sparkSession
    off = _discounts(_few_counts(pairs))
    facts, rest = facts_of(pairs, off)
    less = np.array([0.0, *off])
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = _text_bytes(docs) if size is None else size
    shards = max(1, -(-size // shard_bytes))
    buckets = -(-shards // 2)
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    dealt = docs.select("doc_id", "lang", "text", shard.alias("shard"))

    def hashed(table: pa.Table) -> list[tuple]:
        out = []
        for batch in steps(iter(table.select(["doc_id", "lang", "text"]).to_batches()), size=STEP_BYTES):
            words = Words(batch.column("text"))
            out.append((batch, words, *_pairs(words)))
        return out

    def ask(table: pa.Table) -> pa.Table:
        """The distinct pairs of a shard in order, then its distinct words, cut into buckets."""
        texts = steps(iter(table.select(["text"]).to_batches()), size=STEP_BYTES)
        parts = [_pairs(Words(batch.column("text"))) for batch in texts]
        own, both = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
        rows = []
        # the word before one is a word of the shard too, or the mark
        for first, grams in ((0, _distinct(both)), (buckets, _distinct(np.append(own, _BEGIN)))):
            bounds, some = _buckets(grams, buckets)
            rows += [(int(i) + first, _planes(grams[bounds[i] : bounds[i + 1]])) for i in some]
        at, grams = list(zip(*rows)) if rows else ((), ())
        shard = np.full(len(at), table["shard"][0].as_py(), np.int64)
        return pa.table({"bucket": pa.array(at, pa.int64()), "shard": shard, "grams": pa.array(grams, pa.binary())})

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        """To every question the facts of its hashes, in its order; zeros where there are none."""
        if not asked.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "facts": pa.array([], pa.binary())})
        bucket = asked["bucket"][0].as_py()
        grams = np.concatenate([np.zeros(0, np.uint64), *map(_from_planes, known["grams"].to_pylist())])
        facts = _joined(known["facts"], np.float64).reshape(len(grams), 1 if bucket < buckets else 3)
        in_order = np.argsort(grams)
        grams, facts = grams[in_order], facts[in_order]
        answers = []
        for x in asked["grams"].to_pylist():
            x = _from_planes(x)
            out = np.zeros((len(x), facts.shape[1]))
            if len(grams):
                at = np.minimum(np.searchsorted(grams, x), len(grams) - 1)
                found = grams[at] == x
                out[found] = facts[at[found]]
            answers.append(out.tobytes())
        return pa.table({"shard": asked["shard"], "bucket": asked["bucket"], "facts": pa.array(answers, pa.binary())})

    def answer(table: pa.Table, known: pa.Table) -> pa.Table:
        rows = [pa.table({"doc_id": table["doc_id"][:0], "lang": table["lang"][:0], "nats": pa.array([], pa.float64())})]
        if not table.num_rows:
            return rows[0]
        known = known.sort_by("bucket")
        of_pairs = np.asarray(known["bucket"]) < buckets
        count = _joined(known["facts"].filter(pa.array(of_pairs)), np.float64)
        facts = _joined(known["facts"].filter(pa.array(~of_pairs)), np.float64).reshape(-1, 3)
        parts = hashed(table)
        if parts:
            before, own, both = (np.concatenate([x[i] for x in parts]) for i in (2, 3, 4))
            pair_at, word_at = _sorted(both)[1], _sorted(np.append(own, _BEGIN))[1]
            count = (count - less[np.minimum(count, 3).astype(np.int64)])[pair_at]
            own_at, begin_at = word_at[:-1], word_at[-1]
            context_at = np.where(before == _BEGIN, begin_at, np.append(begin_at, own_at[:-1])[: len(before)])
        upto_word = 0
        for batch, words, *_ in parts:
            data, bounds = raw(batch.column("text"))
            classes, begin = padded(data, bounds, TABLE, order - 1)
            cost = sent.value[codes(classes, order, CLASSES)].astype(np.float64)
            upto = np.concatenate(([0.0], np.cumsum(cost)))
            shift = begin - bounds[:-1] - (order - 1)
            row = words.row()
            nats = upto[begin - (order - 1) + np.diff(bounds)] - upto[begin - (order - 1)]
            if len(row):
                # a word is spelled from the end of the one before it
                start = np.where(np.append([-1], row[:-1]) == row, np.append([0], words.end[:-1]), words.bounds[row])
                spelled = upto[words.end + shift[row]] - upto[start + shift[row]]
                these = slice(upto_word, upto_word + len(row))
                upto_word += len(row)
                part = facts[own_at[these], 0]
                total, spare = facts[context_at[these], 1], facts[context_at[these], 2]
                alone = part + rest * np.exp(-spelled)
                sure = total == 0
                p = np.where(sure, alone, count[these] / np.where(sure, 1.0, total) + spare * alone)
                # where p is too small for a number the spelling itself is left
                better = np.where(p > 0, -np.log(np.where(p > 0, p, 1.0)), spelled)
                nats = nats + np.bincount(row, better - spelled, len(nats))
            size = np.diff(bounds)
            mean = np.divide(nats, size, out=np.full(len(size), np.nan), where=size > 0)
            rows.append(pa.table({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "nats": pa.array(mean, from_pandas=True)}))
        return pa.concat_tables(rows)

    counts = _packed_pairs(pairs, buckets).unionByName(_packed_words(facts, buckets))
    rounds = min(rounds, shards)
    done = []
    for i in range(rounds):
        mine = dealt.where(F.col("shard") % rounds == i)
        asked = mine.groupBy("shard").applyInArrow(ask, "bucket long, shard long, grams binary")
        known = asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(look_up, "shard long, bucket long, facts binary")
        done.append(store(mine.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, f"doc_id {kind}, lang string, nats double")))
    return reduce(DataFrame.unionByName, done)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 by 5: a fifth of the trusted documents."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1


def limits(judged: DataFrame, quantile: float) -> DataFrame:
    """(lang, limit, n_good, n_bad) from exact counts of a fine histogram of ``judged`` (lang, nats, good).

    The limit is the lowest at which the share of good rows above and of bad rows
    up to it are least together.  With fewer than ``LEAST_ROWS`` of either it is the
    quantile of the good rows.
    """
    good = F.col("good").cast("long")
    binned = judged.where("nats IS NOT NULL").groupBy("lang", F.ceil(F.col("nats") / STEP).alias("bin"))
    bins = binned.agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    same = Window.partitionBy("lang")
    order = same.orderBy("bin")
    running = bins.select(
        "lang", "bin", F.sum("good").over(order).alias("g"), F.sum("bad").over(order).alias("b"),
        F.sum("good").over(same).alias("n_good"), F.sum("bad").over(same).alias("n_bad"),
    )
    loss = (F.col("n_good") - F.col("g")) / F.col("n_good") + F.col("b") / F.col("n_bad")
    found = running.where("n_good > 0").groupBy("lang", "n_good", "n_bad").agg(
        F.min_by("bin", F.struct(F.when(F.col("n_bad") > 0, loss), "bin")).alias("best"),
        F.min(F.when(F.col("g") >= F.col("n_good") * quantile, F.col("bin"))).alias("at_quantile"),
    )
    enough = F.least("n_good", "n_bad") >= LEAST_ROWS
    return found.select("lang", (F.when(enough, F.col("best")).otherwise(F.col("at_quantile")) * STEP).alias("limit"), "n_good", "n_bad")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, limit, keep for every document row.

    Trusted are documents with a label of quality 1, bad those that have 0 only.
    A language takes its own limit if it has LEAST_ROWS held-out trusted and bad
    rows, else the one of all languages together if these have so many, else the
    quantile of its own trusted rows, or of all.  Null and empty texts have no
    perplexity and are not kept.  A null language is one of its own.  Where no
    trusted row is held out, those of the counts stand in.  Without any trusted
    text the limit is null and all documents with text are kept.  Repeated labels
    count once; extra columns are not looked at.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    ids = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    ids = ids.withColumn("out", held_out(F.col("doc_id")))
    with brief_shuffles(docs.sparkSession):
        held = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
        trusted = docs.join(held.where("good"), "doc_id")
        some = F.col("good") & (F.col("size") > 0)
        count = docs.select("doc_id", F.octet_length("text").alias("size")).join(held, "doc_id", "left").agg(
            F.count_if(some & ~F.col("out")).alias("counted"), F.count_if(some & F.col("out")).alias("out"),
            F.sum(F.when(some & ~F.col("out"), F.col("size"))).alias("counted_size"), F.sum(F.when(some, F.col("size"))).alias("trusted_size"),
            F.sum("size").alias("size"),
        ).first()
        # with trusted rows of one kind only they are both counted and judged
        apart = bool(count["counted"] and count["out"])
        counted = trusted.where(~F.col("out")) if apart else trusted
        packed = store(pack_counts(counted, size=count["counted_size" if apart else "trusted_size"] or 0))
        scored = score_packed(docs, train(counted), packed, size=count["size"] or 0)
    scored = scored.withColumn("lang_key", F.coalesce("lang", F.lit("\x00")))
    judged = scored.join(held, "doc_id").where((~F.col("good") | F.col("out")) if apart else F.lit(True))
    judged = judged.select(F.col("lang_key").alias("lang"), "nats", "good")
    # a row per language
    per_lang = limits(judged, quantile).withColumnRenamed("lang", "lang_key")
    overall = limits(judged.withColumn("lang", F.lit("all")), quantile).select(
        F.col("limit").alias("overall"), (F.least("n_good", "n_bad") >= LEAST_ROWS).alias("chosen")
    )
    rows = scored.join(per_lang, "lang_key", "left").join(F.broadcast(overall), F.lit(True), "left")
    by_all = F.col("limit").isNull() | (F.col("chosen") & (F.least("n_good", "n_bad") < LEAST_ROWS))
    limit = F.when(by_all, F.col("overall")).otherwise(F.col("limit"))
    return rows.select(
        "doc_id", "lang", F.exp("nats").alias("perplexity"), F.exp(limit).alias("limit"),
        F.when(F.col("nats").isNull(), F.lit(False)).otherwise(F.coalesce(F.col("nats") <= limit, F.lit(True))).alias("keep"),
    )
