"""Toxicity with noisy-channel deobfuscation.

Words that may be disguised (signs or digits for letters, letters set apart,
letters repeated) become lattices of the letters they may stand for; a Viterbi
search under a character language model of the whole corpus finds the likeliest
words; it parts them at separators.  Texts are scored on their own words and the restored ones by a lexicon of
words and word beginnings, learned from labelled rows.

Text is handled as bytes; a word is a run of letters, and every byte from 0x80
on counts as a letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.charmodel import count_cells, dense, kneser_ney, raw
from dqspark.llm.common import grams, mix, small_batches, steps, store

ORDER = 4
#: A break, a to z, all bytes from 0x80 on.
CLASSES = 28
#: Rows a lexicon is learned from at most; they are those with the least digest of the id.
TRAIN_ROWS = 20_000
#: Least share of toxic rows among those with a lexicon entry, and how much clearer than chance it must be (nats).
LEAST_SHARE = 0.9
CLEARER = 0.0
#: Lengths of word beginnings that are features, beside whole words.
HEADS = (4, 5, 6, 7)
#: Bytes of text a step works on: its arrays take some hundred bytes a character.
STEP = 1_000_000
#: Tokens up to this length are decoded once and remembered, up to so many characters in a process.
REMEMBERED, REMEMBERED_CHARACTERS = 128, 4_000_000

# Letters that signs and digits stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
BREAK = [(" ", 0.0), ("", 0.0)]
SIGN_COST, DROP_COST, ONE_OF_TWO, TWO_OF_MANY = 0.7, 6.0, 2.5, 1.0


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = 27
    return out


TABLE = _class_table()
_LETTER = TABLE > 0
_ASCII_LETTER = (TABLE > 0) & (TABLE < 27)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in STANDS_FOR if ord(c) < 128]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Signs of more than one byte, as ``_suspects`` packs them.
_WIDE_SIGN = [int.from_bytes(c.encode(), "little") for c in STANDS_FOR if ord(c) > 127]
_APART = _BLANK.copy()
_APART[[ord(c) for c in "._*-"]] = True
_LOW = np.arange(256)
_LOW[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(77))
_VALUE = (_RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1))[_LOW]
_BASE = np.uint64(0xA0761D6478BD642F)


# --- words and features ------------------------------------------------------


def word_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row and hash of every word, and for each kind of feature (which words, hash)."""
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), []
    size = end - start
    row = np.searchsorted(bounds, start, "right") - 1
    at = np.flatnonzero(letter)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(at)) - np.repeat(begin, size)
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
    upto = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[data[at]] * power[place], dtype=np.uint64)))
    words = mix((upto[begin + size] - upto[begin]) ^ size.astype(np.uint64))
    kinds = [(np.flatnonzero(size >= 3), None)]
    kinds[0] = (kinds[0][0], words[kinds[0][0]])
    for k in HEADS:
        which = np.flatnonzero(size > k)
        kinds.append((which, mix((upto[begin[which] + k] - upto[begin[which]]) ^ np.uint64(1 << (20 + k)))))
    return row, words, kinds


def copy_keys(column: pa.Array) -> np.ndarray:
    """A value that near copies mostly share: the least hash of a text's runs of three words, else of all its words."""
    row, words, _ = word_features(*raw(column))
    out = np.zeros(len(column), np.uint64)
    runs = grams(words, 3)
    inside = row[: len(runs)] == row[2:] if len(runs) else np.zeros(0, bool)
    for rows, values in ((row, words), (row[: len(runs)][inside], runs[inside])):
        if len(rows):
            some, first = np.unique(rows, return_index=True)
            out[some] = np.minimum.reduceat(values, first)
    return out


# --- the noisy channel -------------------------------------------------------


def _suspects(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, bytes]]:
    """(row, token) of everything that may be a disguised word."""
    # places are those of characters
    start = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(start)
    if n < 3:
        return []
    lead, size = data[start], np.diff(np.append(start, len(data)))
    code = _LOW[lead]
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] |= data[start[more] + k].astype(np.int64) << (8 * k)
    bounds = np.searchsorted(start, bounds)
    is_letter = _ASCII_LETTER[lead] | ((lead >= 0xC3) & (lead != 0xE2))
    is_sign = _SIGN[lead] | np.isin(code, _WIDE_SIGN)
    edge = np.zeros(n + 8, bool)
    edge[4 + bounds[:-1][bounds[:-1] < n]] = True

    def wide(mask: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros(4, bool), mask, np.zeros(4, bool)))

    letter, sign, blank = wide(is_letter), wide(is_sign), ~wide(~_BLANK[lead])
    apart = ~wide(~_APART[lead])
    low = np.concatenate((np.zeros(4, np.int64), code, np.zeros(4, np.int64)))
    at = lambda m, k: m[4 + k : 4 + k + n]
    inside = at(sign, 0) & (
        (at(letter, -1) & at(letter, 1))
        | (at(sign, 1) & at(letter, -1) & at(letter, 2))
        | (at(sign, -1) & at(letter, -2) & at(letter, 1))
        | ((at(blank, -1) | at(edge, 0)) & at(letter, 1) & at(letter, 2))
    )
    # at the end of a word, where an exclamation mark is one
    ends = at(sign, 0) & (at(blank, 1) | at(edge, 1)) & (at(low, 0) != ord("!"))
    inside |= ends & at(letter, -2) & (at(letter, -1) | (at(sign, -1) & (at(low, -1) != ord("!"))))
    again = at(letter, 0) & (at(low, 0) == at(low, 1)) & (at(low, 0) == at(low, 2))
    body = letter | sign
    # ends of rows count as blanks for the letters set apart
    before = at(apart, -1) | at(edge, 0)
    after = at(apart, 1) | at(edge, 1)
    single = at(body, 0) & before & after
    wide_single = wide(single)
    spaced = single & (at(wide_single, 2) & at(wide_single, 4))
    seeds = np.flatnonzero(inside | again)
    out: list[tuple[int, int, int]] = []
    if len(seeds):
        cut = np.flatnonzero(_BLANK[lead])
        row = np.searchsorted(bounds, seeds, "right") - 1
        left = np.concatenate(([-1], cut))[np.searchsorted(cut, seeds)] + 1
        right = np.concatenate((cut, [n]))[np.searchsorted(cut, seeds)]
        left, right = np.maximum(left, bounds[row]), np.minimum(right, bounds[row + 1])
        out += np.unique(np.stack((row, left, right), 1), axis=0).tolist()
    places = np.flatnonzero(spaced)
    end = -1
    for p in places.tolist():
        if p < end:
            continue
        r = int(np.searchsorted(bounds, p, "right") - 1)
        stop = p
        while stop + 2 < bounds[r + 1] and single[stop + 2] and not (p < bounds[r + 1] <= stop + 2):
            stop += 2
        end = stop + 1
        if (stop - p) // 2 + 1 >= 3:
            out.append((r, p, stop + 1))
    whole, place = data.tobytes(), np.append(start, len(data)).tolist()
    return [(r, whole[place[a] : place[b]]) for r, a, b in out]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each symbol of a token may stand for: (letters, cost); separators for a break or nothing."""
    out: list[list[tuple[str, float]]] = []
    token = token.lower().rstrip("!?.,;:%&*#'\")") if any(c.isalpha() for c in token) else token.lower()
    i = 0
    while i < len(token):
        c = token[i]
        run = 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        if c.isalpha():
            if run == 1:
                out.append([(c, 0.0)])
            elif run == 2:
                out.append([(c + c, 0.0), (c, ONE_OF_TWO)])
            else:
                out.append([(c, 0.0), (c + c, TWO_OF_MANY)])
        elif c in STANDS_FOR:
            options = [(x, SIGN_COST) for x in STANDS_FOR[c]]
            if run > 1:
                options += [(x + x, SIGN_COST + TWO_OF_MANY) for x in STANDS_FOR[c]]
            out.append([*options, ("", DROP_COST)])
        elif out and out[-1] is not BREAK:
            out.append(BREAK)
        i += run
    return out


class Remembered:
    """The decoded tokens of the one model a process works with; those of an earlier model are forgotten."""

    def __init__(self):
        self.model, self.words, self.characters = None, {}, 0

    def of(self, model: bytes) -> dict[str, str]:
        if model != self.model or self.characters > REMEMBERED_CHARACTERS:
            self.model, self.words, self.characters = model, {}, 0
        return self.words


_REMEMBERED = Remembered()


class Channel:
    """Viterbi decoding of tokens under a character model (costs of all n-gram cells)."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost
        self.name = hashlib.md5(np.ascontiguousarray(cost).tobytes()).digest()

    def decode(self, token: str) -> str:
        if len(token) > REMEMBERED:
            return self._decode(token)
        words = _REMEMBERED.of(self.name)
        found = words.get(token)
        if found is None:
            found = words[token] = self._decode(token)
            _REMEMBERED.characters += len(token) + len(found)
        return found

    def _decode(self, token: str) -> str:
        steps_ = lattice(token)
        if sum(x is not BREAK for x in steps_) < 3:
            return ""
        cost = self.cost
        # a state is the last three classes; each keeps its cheapest way, a chain of letters from the last back.
        # No state is given up: how many there are follows from the options of three symbols.
        ways: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        size = CLASSES ** (ORDER - 1)
        for options in steps_:
            then: dict[int, tuple[float, tuple | None]] = {}
            for state, (spent, text) in ways.items():
                for letters, extra in options:
                    s, c = state, spent + extra
                    for x in letters:
                        cell = s * CLASSES + (ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27)
                        c += cost[cell]
                        s = cell % size
                    if s not in then or c < then[s][0]:
                        then[s] = (c, (text, letters))
            ways = then
        _, way = min(((c + cost[s * CLASSES], w) for s, (c, w) in ways.items()), key=lambda x: x[0])
        out = []
        while way is not None:
            way, letters = way
            out.append(letters)
        return "".join(reversed(out))


def restore(column: pa.Array, channel: Channel) -> list[tuple[int, bytes]]:
    """(row, restored words) of the disguised words of a column of texts."""
    out = []
    for row, token in _suspects(*raw(column)):
        word = channel.decode(token.decode("utf-8", "ignore"))
        if len(word) >= 3:
            out.append((row, word.encode()))
    return out


def features(column: pa.Array, channel: Channel) -> tuple[np.ndarray, np.ndarray, list]:
    """``word_features`` of the texts' own and restored words together."""
    row, words, kinds = word_features(*raw(column))
    more = restore(column, channel)
    if not more:
        return row, words, kinds
    parts = [w for _, w in more]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    other, other_words, other_kinds = word_features(np.frombuffer(b"".join(parts), np.uint8), bounds)
    other = np.array([r for r, _ in more])[other]
    if not kinds:
        return other, other_words, other_kinds
    kinds = [
        (np.concatenate((a[0], b[0] + len(row))), np.concatenate((a[1], b[1]))) for a, b in zip(kinds, other_kinds)
    ] if other_kinds else kinds
    return np.concatenate((row, other)), np.concatenate((words, other_words)), kinds


# --- model -------------------------------------------------------------------


class Model:
    """Lexicon (sorted hashes, weights), the score without a hit, and the channel's costs."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, base: float, cost: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.base, self.cost = hashes[order], weights[order], base, cost
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.hashes >> np.uint64(46)).astype(np.int64)] = True
        self.channel = None

    def __getstate__(self):
        return {**self.__dict__, "channel": None}

    def score(self, column: pa.Array) -> np.ndarray:
        """0 to 1 for every text: distinct words with an entry add up, each by its best feature."""
        self.channel = self.channel or Channel(self.cost)
        n = len(column)
        row, words, kinds = features(column, self.channel)
        weight = np.zeros(len(words))
        for which, value in kinds:
            near = np.flatnonzero(self.maybe[(value >> np.uint64(46)).astype(np.int64)])
            if len(near) and len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, value[near]), len(self.hashes) - 1)
                hit = self.hashes[place] == value[near]
                np.maximum.at(weight, which[near[hit]], self.weights[place[hit]])
        hits = np.flatnonzero(weight)
        pairs = np.unique(np.stack((row[hits].astype(np.uint64), words[hits]), 1), axis=0, return_index=True)[1] if len(hits) else []
        total = np.full(n, self.base)
        np.add.at(total, row[hits[pairs]] if len(hits) else np.zeros(0, np.int64), weight[hits[pairs]] if len(hits) else np.zeros(0))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no rest by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Character model of all texts; lexicon of at most ``train_rows`` labelled rows that are not held out.

    Labels that are null or neither 0 nor 1 are not used; of several labels of
    one document the highest counts.
    """
    small_batches(docs.sparkSession)
    counts = dense(count_cells(docs, TABLE, ORDER, CLASSES), CLASSES**ORDER)
    cost = (-np.log(kneser_ney(counts, ORDER, CLASSES))).astype(np.float32)
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(parts, size=STEP):
            keys = pa.array(copy_keys(batch.column("text")).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), keys], names=["doc_id", "toxic", "key"])

    # copies of one toxic text would make words of all its words: one row of them is enough
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInArrow(sign, f"doc_id {kind}, toxic int, key long")
    alone = store(signed.groupBy("key").agg(F.min(F.struct("doc_id", "toxic")).alias("one")).select("one.*"))
    rows = docs.select("doc_id", "text").join(F.broadcast(alone), "doc_id").select("text", "toxic")

    def offer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(cost)
        for batch in steps(parts, size=STEP):
            toxic = batch.column("toxic").to_numpy()
            row, _, kinds = features(batch.column("text"), channel)
            found = [np.zeros((0, 2), np.uint64)]
            found += [np.stack((row[which].astype(np.uint64), value), 1) for which, value in kinds]
            pairs = np.unique(np.concatenate(found), axis=0)
            names, back = np.unique(pairs[:, 1], return_inverse=True)
            is_toxic = toxic[pairs[:, 0].astype(np.int64)]
            yes = np.bincount(back, is_toxic, len(names)).astype(np.int64)
            no = np.bincount(back, 1 - is_toxic, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(yes), pa.array(no)], names=["feature", "yes", "no"])

    totals = rows.agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).first()
    t, f = int(totals["yes"] or 0), int(totals["no"] or 0)
    if not t:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -5.0, cost)
    rate = min(t / (t + f), 0.5)
    seen = rows.mapInArrow(offer, "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    seen = store(seen.where("yes > 1"))
    weight = F.log((F.col("yes") + 0.5) / (t + 1)) - F.log((F.col("no") + 0.5) / (f + 1))
    # chance of so many toxic rows at the common rate, against the number of features tried
    both = F.col("yes") + F.col("no")
    share = F.col("yes") / both
    gain = F.col("yes") * F.log(share / rate) + F.when(F.col("no") > 0, F.col("no") * F.log((1 - share) / (1 - rate))).otherwise(F.lit(0.0))
    tried = max(2, seen.count())
    lexicon = (
        seen.select("feature", "yes", "no", weight.alias("weight"), gain.alias("gain"))
        .where(((F.col("yes") + 0.5) / (both + 1) >= LEAST_SHARE) & (F.col("gain") >= float(np.log(tried) + CLEARER)))
        .orderBy(F.col("gain").desc(), "feature").toPandas()
    )  # fmt: skip; it is at most what the train rows hold
    base = float(np.log(rate / (1 - rate))) if rate < 0.5 else -1.0
    # one entry alone should pass the middle
    base = min(base, -2.0)
    weights = np.maximum(lexicon["weight"].to_numpy(float), -base + 0.5)
    return Model(lexicon["feature"].to_numpy(np.int64).view(np.uint64), weights, base, cost)


def score_column(docs: DataFrame, model: Model, column: str = "text") -> Column:
    """Scores of a text column; null and empty texts get the score of a text without a hit."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            found = [sent.value.score(part.column("text")) for part in steps(iter([batch]), size=STEP)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return scores(F.col(column))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document row.

    Null and empty texts are scored as texts without a hit.  Without labels, or
    labels of one kind, nothing is in the lexicon and all scores are low.  Rows
    that repeat get equal scores; an empty table gives an empty one; extra
    columns are not looked at.
    """
    model = train(docs, labels, train_rows)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
