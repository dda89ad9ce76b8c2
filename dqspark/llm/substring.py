"""Substring deduplication by super-k-mer partitioning.

A window is 13 consecutive words; its minimiser is the least of its runs of
three words (runs of long words first, then by hash), so consecutive windows
mostly share one.  A stretch of windows with one minimiser is a super-k-mer.

1. Minimisers are counted over all texts.  A stretch whose minimiser stands at one
   place alone cannot repeat and goes no further.
2. The other stretches travel to their minimiser's bucket, each as one packed
   string of words.  There they are sorted by minimiser and document, and each
   window is looked up among those of smaller documents.
3. Where very many stretches share a minimiser, equal stretches are combined
   before the shuffle: all but the smallest document's go whole.  The windows of
   those that are left are dealt by their own digest and sorted, so that a task
   needs to look at the row before only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import Words, grams, small_batches, steps, store

WINDOW = 13
GRAM = 3
#: Stretches of one minimiser beyond which equal ones are combined and windows dealt by their own digest.
CROWDED = 2000
LAST_ID = 2**63 - 1
#: Windows of a stretch at most; texts that repeat one word would give endless ones.
LONGEST = 4096


def stretches(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window in the row, windows, minimiser) of all super-k-mers."""
    inner = window - gram + 1
    hashes = words.hashes()
    n = len(hashes)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    runs = grams(hashes, gram)
    size = np.minimum(words.end - words.start, 255).astype(np.uint64)
    length = sum((size[i : i + len(runs)] for i in range(gram)), np.zeros(len(runs), np.uint64))
    # long words are rare words: runs of few bytes stand behind the others
    rank = (runs >> np.uint64(2)) | (np.where(length >= 24, 0, np.where(length >= 14, 1, 2)).astype(np.uint64) << np.uint64(62))
    least = rank[: n - window + 1].copy()
    for i in range(1, inner):
        np.minimum(least, rank[i : i + len(least)], out=least)
    row = words.row()
    first = words.row_first[:-1]
    starts = np.arange(len(least))
    whole = starts + window <= words.row_first[1:][row[: len(least)]]
    starts, least = starts[whole], least[whole]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1])
    since = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    new |= since % LONGEST == 0
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(starts)))
    rows = row[starts[begin]]
    return rows, starts[begin] - first[rows], count, least[begin]


def _minimisers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(parts):
        row, first, count, least = stretches(Words(batch.column("text")))
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        # one number holds the place and, in its last 16 bits, the number of windows
        yield pa.RecordBatch.from_arrays(
            [pa.array(least.view(np.int64)), pa.array(keys[row]), pa.array((first << 16) | count)], names=["mini", "key", "at"]
        )


def _rows(out: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


LONG, BYTES = pa.int64(), pa.binary()
RUNS, RUN_TYPES = ["id", "tag", "first", "count"], [LONG] * 4


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tag, text, wanted): the packed words of each wanted stretch; crowded ones with a digest."""
    names = ["mini", "id", "tag", "first", "packed", "digest"]
    for batch in steps(parts):
        words = Words(batch.column("text"))
        ids, tags = batch.column("id").to_pylist(), batch.column("tag").to_pylist()
        out: list[tuple] = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            own = words.of_row(i)
            for w in wanted:
                first, count = w["at"] >> 16, w["at"] & 0xFFFF
                if first + count + WINDOW - 1 > len(own):  # another row's, by its key
                    continue
                packed = b" ".join(own[first : first + count + WINDOW - 1])
                out.append((w["mini"], ids[i], tags[i], first, packed, _digest(packed) if w["crowded"] else None))
        yield _rows(out, names, [LONG, LONG, LONG, LONG, BYTES, BYTES])


def _runs(doc: int, tag: int, places: list[int]) -> list[tuple]:
    """Rising places as (id, tag, first, count)."""
    out: list[list[int]] = []
    for p in places:
        if out and out[-1][0] + out[-1][1] == p:
            out[-1][1] += 1
        else:
            out.append([p, 1])
    return [(doc, tag, first, count) for first, count in out]


def _count_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (mini, id): windows that stood in a document of a smaller id before."""
    seen: dict[bytes, int] = {}
    current = None
    for batch in parts:
        out: list[tuple] = []
        for mini, doc, tag, first, packed in zip(*(batch.column(c).to_pylist() for c in ("mini", "id", "tag", "first", "packed"))):
            if mini != current:
                seen, current = {}, mini
            words = packed.split(b" ")
            gone = []
            for k in range(len(words) - WINDOW + 1):
                if seen.setdefault(_digest(b" ".join(words[k : k + WINDOW])), doc) < doc:
                    gone.append(first + k)
            out += _runs(doc, tag, gone)
        yield _rows(out, RUNS, RUN_TYPES)


def _single_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        out: list[tuple] = []
        for doc, tag, first, packed in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "first", "packed"))):
            words = packed.split(b" ")
            out += [(_digest(b" ".join(words[k : k + WINDOW])), doc, tag, first + k) for k in range(len(words) - WINDOW + 1)]
        yield _rows(out, ["window", "id", "tag", "first"], [BYTES, LONG, LONG, LONG])


def _later(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (window, id): those behind the smallest id of their window."""
    current, smallest = None, 0
    for batch in parts:
        out: list[tuple] = []
        for window, doc, tag, first in zip(*(batch.column(c).to_pylist() for c in ("window", "id", "tag", "first"))):
            if window != current:
                current, smallest = window, doc
            elif doc > smallest:
                out.append((doc, tag, first, 1))
        yield _rows(out, RUNS, RUN_TYPES)


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(parts):
        words = Words(batch.column("text"))
        kept, removed = [], []
        for i, runs in enumerate(batch.column("runs")):
            n = int(words.per_row[i])
            cover = np.zeros(n + 1, np.int64)
            if runs.is_valid and len(runs.values):
                first, count = (runs.values.field(c).to_numpy() for c in ("first", "count"))
                np.add.at(cover, first, 1)
                np.add.at(cover, np.minimum(first + count + WINDOW - 1, n), -1)
            keep = np.cumsum(cover[:n]) == 0
            pieces = compress(words.of_row(i), keep)
            kept.append(b" ".join(pieces).decode("utf-8", "replace"))
            removed.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words.per_row.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the kept words joined by one space) of every document row.

    A word goes if a window that covers it also starts in a document of a
    smaller doc_id.  Windows are judged on the input.  Null and blank texts have
    no words; a null doc_id counts as larger than all others; rows that share a
    doc_id are not smaller than each other, so copies of a row stay or go alike.
    An empty table gives an empty one.  Extra columns are not looked at.
    """
    small_batches(docs.sparkSession, 1000)
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text")
    )
    # rows that happen to share a key only have more stretches looked at
    key = F.xxhash64("id", "tag").alias("key")
    small = rows.select(key, "text").mapInArrow(_minimisers, "mini long, key long, at long")
    alike = Window.partitionBy("mini")
    repeated = (
        small.withColumn("n", F.count(F.lit(1)).over(alike)).where("n > 1")
        .groupBy("key").agg(F.collect_set(F.struct("mini", "at", (F.col("n") > crowded).alias("crowded"))).alias("wanted"))
    )
    repeated = store(repeated)
    asked = rows.select(key, "id", "tag", "text").join(repeated.hint("shuffle_hash"), "key")
    packed = store(asked.select("id", "tag", "text", "wanted").mapInArrow(_pack, "mini long, id long, tag long, first long, packed binary, digest binary"))
    runs = "id long, tag long, first long, count long"
    plain = packed.where("digest IS NULL").select("mini", "id", "tag", "first", "packed")
    found = plain.repartition("mini").sortWithinPartitions("mini", "id").mapInArrow(_count_windows, runs)
    crowd = packed.where("digest IS NOT NULL").select("digest", "id", "tag", "first", "packed")
    smallest = crowd.groupBy("digest").agg(F.min("id").alias("smallest"))
    crowd = store(crowd.join(smallest, "digest").withColumn("again", F.col("id") > F.col("smallest")))
    windows = F.size(F.split(F.col("packed").cast("string"), " ")) - (WINDOW - 1)
    again = crowd.where("again").select("id", "tag", "first", windows.cast("long").alias("count"))
    single = crowd.where("NOT again").select("id", "tag", "first", "packed")
    single = single.mapInArrow(_single_windows, "window binary, id long, tag long, first long")
    later = single.repartition("window").sortWithinPartitions("window", "id").mapInArrow(_later, runs)
    gone = found.unionByName(again).unionByName(later)
    gone = store(gone.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("runs")))
    joined = rows.join(gone.hint("shuffle_hash"), ["id", "tag"], "left").select("doc_id", "text", "runs")
    id_type = docs.schema["doc_id"].dataType
    return joined.mapInArrow(_cut, f"doc_id {id_type.simpleString()}, n_words long, n_removed long, kept string")


def digest_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
