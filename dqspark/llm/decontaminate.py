"""Benchmark decontamination over a distributed positional inverted index.

All of it is DataFrame functions.  Postings (term, document, position) of the
training texts are stored for the terms that lookups begin with.  Every window
of a test item has an anchor, its rarest term in the corpus, and a second rarest;
windows that share these positions share the lookup.  The anchor's list, its
positions lowered by the anchor's offset, gives alignments of item and document;
the second list, adjusted likewise, is intersected with it by an equi-join.
What is left is compared word by word for exact windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import lower_ascii, store, words_of

#: Everything of ASCII but letters and digits separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows up to which a table is sent to all tasks; beyond, it is joined by a shuffle.
BROADCAST_TERMS = 1_000_000
BROADCAST_DOCS = 60_000


def terms_of(text: Column) -> Column:
    return words_of(lower_ascii(text), SEPARATORS)


def sent(df: DataFrame, most: int) -> DataFrame:
    """With a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= most else df


def keyed(docs: DataFrame) -> DataFrame:
    """Rows by the digests of id and text, so that null and repeated ids do not mix texts."""
    return docs.select(
        "doc_id", F.xxhash64("doc_id").alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"),
        terms_of(F.col("text")).alias("words"),
    )


def item_words(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, words, n): distinct items with words; n is the length of their windows."""
    words = terms_of(F.col("text"))
    return (
        items.select("item_id", words.alias("item_words")).distinct().where(F.size("item_words") > 0)
        .withColumn("item", F.xxhash64("item_id", "item_words"))
        .withColumn("n", F.least(F.lit(window), F.size("item_words")))
    )


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in the corpus of each term of ``vocabulary`` (term) that occurs."""
    held = sent(vocabulary, BROADCAST_TERMS)
    return keyed(docs).select(F.explode("words").alias("term")).join(held, "term").groupBy("term").count()


def build_index(docs: DataFrame, vocabulary: DataFrame, folder: str | None = None) -> DataFrame:
    """Stored postings (term, k1, k2, pos) of the terms of ``vocabulary``."""
    held = sent(vocabulary, BROADCAST_TERMS)
    found = keyed(docs).select("k1", "k2", F.posexplode("words").alias("pos", "term")).join(held, "term")
    return store(found.select("term", "k1", "k2", "pos"), folder)


def lookups(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, a, term_a, b, term_b): positions of the rarest and second rarest term of every window.

    Windows with a term that the corpus lacks cannot occur and are left out.  A
    window of one word has no second term.
    """
    places = items.select("item", "n", F.size("item_words").alias("len"), F.posexplode("item_words").alias("i", "term"))
    known = places.join(counts, "term")
    starts = F.sequence(F.greatest(F.lit(0), F.col("i") - F.col("n") + 1), F.least(F.col("i"), F.col("len") - F.col("n")))
    ranked = Window.partitionBy("item", "start").orderBy("count", "i")
    spots = known.select("item", "n", "i", "term", "count", F.explode(starts).alias("start"))
    spots = spots.withColumn("here", F.count(F.lit(1)).over(Window.partitionBy("item", "start"))).where("here = n")
    spots = spots.withColumn("rank", F.row_number().over(ranked)).where("rank <= 2")
    first = F.min(F.when(F.col("rank") == 1, F.struct("i", "term")))
    second = F.min(F.when(F.col("rank") == 2, F.struct("i", "term")))
    both = spots.groupBy("item", "start").agg(first.alias("f"), second.alias("s"))
    return both.select(
        "item", F.col("f.i").alias("a"), F.col("f.term").alias("term_a"), F.col("s.i").alias("b"), F.col("s.term").alias("term_b")
    ).distinct()


def alignments(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(k1, k2, item, delta): where the two rarest terms of a window stand as in the item."""
    begun = index.join(sent(asked, BROADCAST_TERMS), F.col("term") == F.col("term_a")).select(
        "k1", "k2", "item", (F.col("pos") - F.col("a")).alias("delta"), "b", "term_b"
    )
    alone = begun.where("b IS NULL").select("k1", "k2", "item", "delta")
    other = index.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("term").alias("other"), "pos")
    met = begun.where("b IS NOT NULL").join(
        other,
        (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & (F.col("term_b") == F.col("other")) & (F.col("delta") + F.col("b") == F.col("pos")),
    )
    return met.select("k1", "k2", "item", "delta").unionByName(alone).distinct()


def _exact_starts(words: Column, hit: Column) -> Column:
    """Starts in the document of the item's windows that occur under an alignment."""
    n, item, delta = hit["n"], hit["item_words"], hit["delta"]
    low = F.greatest(F.lit(0), -delta)
    high = F.least(F.size(item), F.size(words) - delta) - n
    same = lambda j: F.slice(words, delta + j + 1, n) == F.slice(item, j + 1, n)
    tried = F.filter(F.sequence(low, F.greatest(low, high)), lambda j: (j <= high) & same(j))
    return F.transform(tried, lambda j: delta + j)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document row: doc_id, n_words, matches (item_id, start, length), hit_words, item_ids.

    Null texts have no words and no matches; items without words match nothing;
    an item shorter than the window is one window.  Rows that repeat are judged
    one by one; null item ids count as words hit but are not listed.  Empty
    tables give no rows, or rows without matches.
    """
    tests = store(item_words(items, window))
    vocabulary = tests.select(F.explode("item_words").alias("term")).distinct()
    counts = store(term_counts(docs, vocabulary))
    asked = store(lookups(tests, counts))
    needed = asked.select(F.col("term_a").alias("term")).union(asked.where("term_b IS NOT NULL").select("term_b")).distinct()
    index = build_index(docs, needed)
    lined = alignments(index, asked).join(sent(tests, BROADCAST_DOCS), "item")
    per_doc = store(
        lined.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "item_words", "n", "delta")).alias("hits"))
    )
    per_doc = sent(per_doc, BROADCAST_DOCS)
    words = F.col("words")
    matched = F.transform(
        F.coalesce("hits", F.array().cast(per_doc.schema["hits"].dataType)),
        lambda h: F.struct(h["item_id"].alias("item_id"), h["n"].alias("length"), _exact_starts(words, h).alias("starts")),
    )
    rows = keyed(docs).join(per_doc, ["k1", "k2"], "left").select("doc_id", F.size("words").cast("long").alias("n_words"), matched.alias("m"))
    rows = rows.withColumn("m", F.filter("m", lambda m: F.size(m["starts"]) > 0))
    places = F.transform("m", lambda m: F.flatten(F.transform(m["starts"], lambda s: F.sequence(s, s + m["length"] - 1))))
    return rows.select(
        "doc_id", "n_words",
        F.flatten(F.transform("m", lambda m: F.transform(m["starts"], lambda s: F.struct(m["item_id"].alias("item_id"), s.alias("start"), m["length"].alias("length"))))).alias("matches"),
        F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_hit"),
        F.array_sort(F.array_compact(F.array_distinct(F.transform("m", lambda m: m["item_id"].cast("string"))))).alias("item_ids"),
    )


def proximity_matches(docs: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """(phrase_id, doc_id, at): documents where all terms of a phrase stand in ``within`` consecutive words.

    ``phrases`` has phrase_id and text.  ``at`` is the position of the rarest
    term.  Each other distinct term is looked for in the postings around it;
    terms are counted once, in any order.
    """
    asked = phrases.select("phrase_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct()
    counts = store(term_counts(docs, asked.select("term").distinct()))
    index = build_index(docs, counts.select("term"))
    whole = asked.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("needed"))
    rare = asked.join(counts, "term").withColumn("rank", F.row_number().over(Window.partitionBy("phrase_id").orderBy("count", "term")))
    first = index.join(rare.where("rank = 1").select("phrase_id", "term"), "term").select("phrase_id", "k1", "k2", F.col("pos").alias("at"))
    near = first.join(index.join(asked, "term").select("phrase_id", "k1", "k2", "term", "pos"), ["phrase_id", "k1", "k2"])
    near = near.where(F.abs(F.col("pos") - F.col("at")) < within)
    starts = F.explode(F.sequence(F.col("at") - within + 1, F.col("at")))
    spans = near.select("phrase_id", "k1", "k2", "at", "term", "pos", starts.alias("start")).where(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + within)
    )
    full = spans.groupBy("phrase_id", "k1", "k2", "at", "start").agg(F.count_distinct("term").alias("have")).join(whole, "phrase_id")
    found = full.where("have = needed").select("phrase_id", "k1", "k2", "at").distinct()
    ids = keyed(docs).select("doc_id", "k1", "k2")
    return found.join(ids, ["k1", "k2"]).select("phrase_id", "doc_id", "at")


def digest_rows(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_contamination``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
