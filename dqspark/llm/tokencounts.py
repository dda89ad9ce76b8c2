"""Token counts by compiled transducers instead of a tokenizer run.

A vocabulary file of byte-pair merges with word ends is compiled into two
deterministic transducers in a row.

* The *splitter* reads character classes and marks where words begin; it has
  eight states.  Text is cut into chunks; each gives the map from every state it
  may be entered in to the state it is left in.  A parallel prefix scan composes
  the maps, which gives each chunk its true entry, and the marks follow.
* The *merger* reads bytes of words, the last byte of a word being a symbol of
  its own, and its transitions are annotated with the tokens they emit (a token
  that a longer one takes back counts minus one).  Two neighbours in a string of
  tokens stay apart exactly if merging the two alone gives the two again, so the
  last token of every prefix follows from the last tokens of shorter prefixes; a
  state is what later bytes can ask of them, i.e. the last token at every place
  from which a token may still run on.  States are made when first met and kept
  in a table of bounded size.  All chunks step through it side by side.  A chunk
  inside a long word is entered in the state that its predecessor leaves; maps
  are taken from a guess (the state after the stretch before it) and taken again
  where the scan finds another entry.

Tokenizers are read, never trained; character classes, lower case and
normalisation are asked from the tokenizer's own pieces once per process.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

CHUNK = 256
#: Characters of a piece of text that is worked on at once; pieces end at a blank.
PIECE = 1_000_000
#: States and pairs of tokens that a process remembers before it begins anew.
STATES, PAIRS = 150_000, 300_000
#: Code points from here on are letters or not, but never change under normalisation below it.
_PLAIN = 0x300

# The parts of the vocabulary file this compiler reads.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

# Character classes: ends of texts, blanks, letters without a part in short forms, digits, others, the apostrophe,
# and the letters of the short forms 's 't 'm 'd, 're, 've, 'll.
END, BLANK, LETTER, DIGIT, OTHER, APOSTROPHE, SHORT, R, V, L, E = range(11)
CLASSES = 11
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = (LETTER, SHORT, R, V, L, E)
# States: between words (a blank, a digit or a whole short form was read), in letters, in others,
# behind an apostrophe that opened a word, and behind its r, v or l.
APART, IN_LETTERS, IN_OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, OUTSIDE = range(8)


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by (class, state): 1 a word begins here, 2 a word began one character before."""
    turn = np.zeros((CLASSES, 8), np.uint8)
    mark = np.zeros((CLASSES, 8), np.uint8)

    def fresh(c: int) -> int:
        if c in (END, BLANK):
            return OUTSIDE
        if c in _LETTERS:
            return IN_LETTERS
        return {DIGIT: APART, OTHER: IN_OTHERS, APOSTROPHE: QUOTE}[c]

    for c in range(CLASSES):
        for s in range(8):
            begins, late = True, False
            to = fresh(c)
            letters = s == IN_LETTERS
            if s in (QUOTE_R, QUOTE_V, QUOTE_L):
                if (s, c) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
                    turn[c, s] = APART
                    continue
                late, letters = True, True  # the apostrophe stood alone, a word of letters began behind it
            if letters and c in _LETTERS:
                begins = False
            elif s == IN_OTHERS and c in (OTHER, APOSTROPHE):
                begins, to = False, IN_OTHERS
            elif s == QUOTE:
                if c in (OTHER, APOSTROPHE):
                    begins, to = False, IN_OTHERS
                elif c == SHORT:
                    begins, to = False, APART
                elif c in (R, V, L):
                    begins, to = False, {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c]
            turn[c, s] = to
            mark[c, s] = (1 if begins and c not in (END, BLANK) else 0) | (2 if late else 0)
    return turn, mark


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps one behind another, per row."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the composition of rows 0 to i, in as many rounds as the number of rows has bits."""
    maps = maps.copy()
    reach = 1
    while reach < len(maps):
        maps[reach:] = compose(maps[:-reach], maps[reach:])
        reach *= 2
    return maps


def word_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where words begin in a sequence of classes that ends with END."""
    turn, mark = splitter()
    n = len(classes)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    flat = turn.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for column in columns:
        maps = flat[(column.astype(np.uint16) * 8)[:, None] + maps]
    entry = np.full(lanes, OUTSIDE, np.uint8)
    entry[1:] = prefix_scan(maps)[:-1, OUTSIDE]
    out = np.zeros((chunk, lanes), np.uint8)
    state = entry
    marks = mark.ravel()
    for i, column in enumerate(columns):
        at = column.astype(np.uint16) * 8 + state
        out[i] = marks[at]
        state = flat[at]
    marked = out.T.ravel()[:n]
    begins = (marked & 1).astype(bool)
    begins[:-1] |= (marked[1:] & 2).astype(bool)
    return begins


class Merger:
    """Transducer of the words of a vocabulary, its states made when first met."""

    #: Places of the table of transitions; it doubles when half full and begins anew between calls.
    SLOTS = 1 << 19
    #: What the first state lists: the root, no token before, none counted.
    FIRST = 256

    def __init__(self, merges: list[tuple[int, int]], base: int):
        """``merges`` are pairs of ids; merge i makes id ``base + i``, ids below are the symbols."""
        self.base = base
        self.parts = [(-1, -1)] * base + merges
        self.rank = {pair: i for i, pair in enumerate(merges)}
        spelt: list[tuple[int, ...]] = [(i,) for i in range(base)]
        sound = [True] * base
        for i, (a, b) in enumerate(merges):
            spelt.append(spelt[a] + spelt[b])
            sound.append(sound[a] and sound[b] and self._stay_apart(a, b, i))
        if max(map(len, spelt)) > 255 or len(spelt) >= 1 << 19:
            raise ValueError("tokens of more than 255 bytes, or more of them than a state can name")
        # a tree of the spellings: child by node and symbol, the token that ends there, whether any runs on
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, spelling in enumerate(spelt):
            if not sound[token]:
                continue  # never comes out of the merges
            node = 0
            for symbol in spelling:
                self.inner[node] = True
                key = node << 9 | symbol
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = token
        self._clear()

    def _clear(self) -> None:
        self._empty(self.SLOTS)
        self.meaning: list[tuple] = [(self.FIRST,)]
        self.numbers = {self.meaning[0]: 0}
        self.apart: dict[int, bool] = {}

    def _empty(self, slots: int) -> None:
        self.keys = np.full(slots, -1, np.int64)
        self.to = np.zeros(slots, np.int32)
        self.emit = np.zeros(slots, np.int32)
        self.used = 0
        self.drop = np.uint64(65 - slots.bit_length())

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where the search for a key begins."""
        return ((key.astype(np.uint64) * _SPREAD) >> self.drop).astype(np.int64)

    def _stay_apart(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge joins the end of a with the beginning of b (before a given rank).

        The last part of a, its last part and so on each live from their own merge
        to the next one's; so do the first parts of b.  A pair of parts that live
        at the same time is joined if its rank comes before the merge that ends
        either (of equal ranks the left place comes first).
        """
        rank, parts, base = self.rank, self.parts, self.base
        a_ends = b_ends = before
        while True:
            r = rank.get((a, b))
            if r is not None and r < a_ends and (r <= b_ends and r < before):
                return False
            if a < base and b < base:
                return True
            if a >= b:
                a_ends, a = a - base, parts[a][1]
            else:
                b_ends, b = b - base, parts[b][0]

    def _make(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and tokens emitted.

        A state lists, for every place from which a token may still run on, the node
        it has reached, the last token before it (plus 1) and the tokens up to
        there, counted from where the state stands (plus 256).
        """
        longer, last, more = [], -1, 0
        child, tokens = self.child, self.token
        for entry in self.meaning[state]:
            to = child.get((entry >> 28) << 9 | symbol)
            if to is None:
                continue
            if last < 0:
                token, previous = tokens[to], (entry >> 9 & 0x7FFFF) - 1
                if token >= 0 and (previous < 0 or self._apart(previous, token)):
                    last, more = token, (entry & 511) - 255
            if self.inner[to]:
                longer.append(to << 28 | entry & 0xFFFFFFF)
        if symbol >= 256:
            return 0, more
        meaning = (*(entry - more for entry in longer), (last + 1) << 9 | 256)
        number = self.numbers.get(meaning)
        if number is None:
            number = self.numbers[meaning] = len(self.meaning)
            self.meaning.append(meaning)
        return number, more

    def _apart(self, a: int, b: int) -> bool:
        found = self.apart.get(a << 19 | b)
        if found is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            found = self.apart[a << 19 | b] = self._stay_apart(a, b)
        return found

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One symbol in every lane."""
        key = (state.astype(np.int64) << 9) | symbol
        slot, there = self._search(key)
        missing = there == -1
        if missing.any():
            self._put([(k, *self._make(k >> 9, k & 511)) for k in np.unique(key[missing]).tolist()])
            slot, _ = self._search(key)
        return self.to[slot], self.emit[slot]

    def _search(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every key, or the free one where it would go."""
        slot = self._place(key)
        there = self.keys[slot]
        other = np.flatnonzero((there != key) & (there != -1))
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.keys)
            there[other] = self.keys[slot[other]]
            other = other[(there[other] != key[other]) & (there[other] != -1)]
        return slot, there

    def _put(self, rows) -> None:
        """Transitions (key, next state, emitted) that are not there yet."""
        key, to, emit = np.array(rows, np.int64).T
        if 2 * (self.used + len(key)) > len(self.keys):
            there = self.keys >= 0
            old = [self.keys[there], self.to[there], self.emit[there]]
            self._empty(2 * len(self.keys))
            self._put(np.stack(old, 1))
            return self._put(rows)
        self.used += len(key)
        while len(key):
            slot, _ = self._search(key)
            _, first = np.unique(slot, return_index=True)
            at = slot[first]
            self.keys[at], self.to[at], self.emit[at] = key[first], to[first], emit[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, to, emit = key[rest], to[rest], emit[rest]

    def full(self) -> bool:
        return len(self.meaning) > STATES

    def run(self, symbols: np.ndarray, bounds: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and emitted tokens of the chunks between bounds, all side by side."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        start, size = bounds[:-1][order], size[order]
        state, count = entry[order].astype(np.int32), np.zeros(len(order), np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -i, "left"))
            state[:live], emitted = self.step(state[:live], symbols[start[:live] + i])
            count[:live] += emitted
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def count(self, symbols: np.ndarray, ends: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of stretches of whole words that end at ``ends``; symbols from 256 on end a word."""
        if self.full():
            self._clear()
        total = len(symbols)
        if not total:
            return np.zeros(len(ends), np.int64)
        # cut behind the end of a word near every multiple of the chunk, or within the word where it is long
        stops = np.flatnonzero(symbols >= 256) + 1
        grid = np.arange(chunk, total, chunk)
        near = stops[np.minimum(np.searchsorted(stops, grid), len(stops) - 1)]
        cuts = np.where(near < grid + chunk, near, grid)
        bounds = np.unique(np.concatenate(([0], cuts, ends, [total])))
        inside = np.concatenate(([False], symbols[bounds[1:-1] - 1] < 256))  # chunk continues a word
        entry = np.zeros(len(bounds) - 1, np.int32)
        guessed = np.flatnonzero(inside)
        if len(guessed):
            back = np.maximum(bounds[guessed] - 64, 0)
            pairs = np.stack([back, bounds[guessed]], 1)
            entry[guessed] = self._after(symbols, pairs)
        leave, count = self.run(symbols, bounds, entry)
        while len(guessed):
            wrong = guessed[entry[guessed] != leave[guessed - 1]]
            if not len(wrong):
                break
            entry[wrong] = leave[wrong - 1]
            again = [self.run(symbols, bounds[w : w + 2], entry[w : w + 1]) for w in wrong.tolist()] if len(wrong) < 8 else None
            if again is None:
                ranges = np.stack([bounds[wrong], bounds[wrong + 1]], 1)
                leave[wrong], count[wrong] = self._ranges(symbols, ranges, entry[wrong])
            else:
                for w, (s, c) in zip(wrong.tolist(), again):
                    leave[w], count[w] = s[0], c[0]
        upto = np.concatenate(([0], np.cumsum(count)))
        return np.diff(np.concatenate(([0], upto[np.searchsorted(bounds, ends)])))

    def _after(self, symbols: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        return self._ranges(symbols, ranges, np.zeros(len(ranges), np.int32))[0]

    def _ranges(self, symbols: np.ndarray, ranges: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``run`` over stretches that need not adjoin."""
        size = ranges[:, 1] - ranges[:, 0]
        bounds = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(ranges[:, 0] - bounds[:-1], size) + np.arange(int(size.sum()))
        return self.run(symbols[at], bounds, entry)


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in such vocabulary files: printable ones for themselves, then from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(itself)]
    return {**{chr(b): b for b in itself}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Counter:
    """The compiled tokenizer of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import NormalizedString, PreTokenizedString, Regex, normalizers, pre_tokenizers  # noqa: F401

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._refuse_others(spec)
        letters = _byte_letters()
        ids: dict[tuple[bytes, bool], int] = {}
        end = spec["model"]["end_of_word_suffix"]

        def key(text: str) -> tuple[bytes, bool]:
            whole = text.endswith(end) and len(text) > len(end)
            return bytes(letters[c] for c in (text[: -len(end)] if whole else text)), whole

        for b in range(256):
            ids[bytes([b]), False] = b
            ids[bytes([b]), True] = 256 + b
        merges = []
        for i, (a, b) in enumerate(spec["model"]["merges"]):
            (x, _), (y, whole) = key(a), key(b)
            merges.append((ids[x, False], ids[y, whole]))
            if (x + y, whole) in ids:
                raise ValueError("two merges of the file make the same token")
            ids[x + y, whole] = 512 + i
        self.merger = Merger(merges, 512)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.nfc = normalizers.NFC()
        self._tables(normalizers.Lowercase(), pre_tokenizers, Regex)

    @staticmethod
    def _refuse_others(spec: dict) -> None:
        """Files whose steps are not those compiled here are refused, not counted wrongly."""
        model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [n["type"] for n in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        fits = (
            model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
            and not model.get("ignore_merges") and not model.get("byte_fallback") and steps == NORMALIZERS
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"].get("Regex") == SPLIT_PATTERN and parts[0]["invert"] and parts[0]["behavior"] == "Removed"
            and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError("the file holds another kind of tokenizer than byte pairs with word ends")

    def _tables(self, lower, pre_tokenizers, regex) -> None:
        """Class and lower case of every code point, as the tokenizer's own steps give them."""
        points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000], np.uint32)
        classes = np.full(0x110000, OTHER, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.wide: dict[int, np.ndarray] = {}
        for pattern, kind in ((r"\s", BLANK), (r"\p{L}", LETTER), (r"\p{N}", DIGIT)):
            cut = pre_tokenizers.Split(regex(pattern), "removed", invert=True)
            for start in range(0, len(points), 50_000):
                some = points[start : start + 50_000]
                text = some.tobytes().decode("utf-32-le")
                for _, (a, _) in cut.pre_tokenize_str(text):
                    classes[some[a]] = kind
        changed = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p).lower() != chr(p)]
        for p in changed:
            new = lower.normalize_str(chr(p))
            if len(new) == 1:
                self.lower[p] = ord(new)
            else:
                self.wide[p] = np.frombuffer(new.encode("utf-32-le"), np.uint32)
        for letter in "stmd":
            classes[ord(letter)] = SHORT
        classes[ord("r")], classes[ord("v")], classes[ord("l")], classes[ord("e")] = R, V, L, E
        classes[ord("'")] = APOSTROPHE
        self.classes = classes

    def _points(self, text: str) -> np.ndarray:
        """Code points after normalisation and lower case."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) and points.max() >= _PLAIN:
            points = np.frombuffer(self.nfc.normalize_str(text).encode("utf-32-le"), np.uint32)
        if self.wide:
            at = np.flatnonzero(np.isin(points, list(self.wide))) if len(points) and points.max() > 127 else ()
            if len(at):
                cut = np.split(points, at)
                points = np.concatenate([cut[0], *(x for c in cut[1:] for x in (self.wide[int(c[0])], c[1:]))])
        return self.lower[points]

    def sections(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Stretches between special strings, the row of each, and the special strings of every row."""
        out, rows, special = [], [], [0] * len(texts)
        for row, text in enumerate(texts):
            found = self.added.split(text) if self.added and self.added.search(text) else [text]
            special[row] = len(found) - 1
            for section in found:
                for piece in _pieces(section):
                    out.append(piece)
                    rows.append(row)
        return out, rows, special

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        sections, rows, special = self.sections(texts)
        out = np.array(special, np.int64)
        start = 0
        while start < len(sections):
            stop, size = start, 0
            while stop < len(sections) and (stop == start or size + len(sections[stop]) <= PIECE):
                size += len(sections[stop])
                stop += 1
            np.add.at(out, np.array(rows[start:stop]), self._count_sections(sections[start:stop]))
            start = stop
        return out

    def _count_sections(self, sections: list[str]) -> np.ndarray:
        points = [self._points(s) for s in sections]
        sizes = np.array([len(p) for p in points])
        ends = np.cumsum(sizes + 1)  # an END behind every section
        whole = np.zeros(int(ends[-1]), np.uint32)
        classes = np.full(len(whole), END, np.uint8)
        for p, e in zip(points, ends.tolist()):
            whole[e - 1 - len(p) : e - 1] = p
            classes[e - 1 - len(p) : e - 1] = self.classes[p]
        begins = word_starts(classes)
        solid = classes > BLANK
        # the last character of a word stands before a beginning or before what is no word
        last = solid.copy()
        last[:-1] &= begins[1:] | ~solid[1:]
        kept = np.flatnonzero(solid)
        value = whole[kept]
        width = 1 + (value >= 0x80) + (value >= 0x800) + (value >= 0x10000)
        data = np.frombuffer(value.tobytes().decode("utf-32-le").encode(), np.uint8)
        close = np.cumsum(width)
        symbols = data.astype(np.int64)
        symbols[close[last[kept]] - 1] += 256
        until = np.concatenate(([0], close))[np.searchsorted(kept, ends)]
        return self.merger.count(symbols, until)


def _pieces(text: str) -> list[str]:
    """Pieces of about ``PIECE`` characters that end behind a blank; a blank changes nothing around it."""
    if len(text) <= PIECE:
        return [text]
    out, start = [], 0
    while start < len(text):
        stop = start + PIECE
        if stop < len(text):
            found = [i for i in (text.find(c, stop) for c in " \n\t") if i >= 0]
            stop = min(found) + 1 if found else len(text)
        out.append(text[start:stop])
        start = stop
    return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a column of texts; null counts as empty.  The file must lie at ``path`` on every machine."""

    @F.arrow_udf(LongType())
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path).count
        for batch in batches:
            out, start = [], 0
            size = pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(size)
            while start < len(batch):
                before = upto[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, before + PIECE, "right")))
                out.append(count(["" if t is None else t for t in batch.slice(start, stop - start).to_pylist()]))
                start = stop
            yield pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return tokens(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null and empty texts have 0 of both.  Every row is counted by itself, so
    repeated rows and ids give equal rows again; an empty table stays empty.
    Columns of these names are replaced, all others stay.  Texts of any length
    are worked on in pieces that end at a blank; special strings inside a text
    count as one token each, as the tokenizer's default has it.
    """
    held = F.col(text)
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(held), F.lit(0)).cast("long"))
        .withColumn("n_tokens", n_tokens(held, path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
