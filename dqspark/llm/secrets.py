"""Secret scans by assignment-aware lexing.

A text is read as if it were source or configuration.  A name and one of ``=``,
``:``, ``:=``, ``=>`` open a pair; behind it a small grammar reads the value:
literals with prefixes (``b"..."``), in triple quotes or brackets, one behind
another or joined by ``+``, lists, calls (of ``getenv("X", "...")`` the default
counts), values behind ``or``, literals of the next line, YAML blocks and bare
values.  XML elements and ``key=... value=...`` attributes are pairs too.  A name
that was given a constant before hands it on (``a = "..."`` then ``password = a``),
and the literals themselves are reported too, as ``constant``.  A pair is a secret
if the scores of its target name and of its value reach a limit together.  Three
plain patterns are always reported beside these.

A constant is kept as its length, its characters' counts and links to its
literals, and as text up to ``TEXT_KEPT`` characters only, so texts that join
constants over and over take no more memory than their lines.

Null texts are read as empty.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed", "propagated", "constant")
LEAST_VALUE = 8

# What names of secrets are made of, with how much each tells.
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0,
    "api_key": 1.0, "api-key": 1.0, "access_key": 1.0, "accesskey": 1.0, "private_key": 1.0, "credential": 0.8,
    "auth": 0.5, "bearer": 0.7, "session_key": 0.7, "signing_key": 0.9, "encryption_key": 0.9, "client_key": 0.7,
    "connection_string": 0.7, "salt": 0.4,
}
#: Values that stand for a secret to be put in.
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|placeholder|none|null|true|false|undefined|todo|redacted|test|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$"
)
#: The weakest name reaches it with a value of full score.
SCORE = 0.63

#: Words of sentences: a value of several words with one of them is no pass phrase.
SENTENCE = frozenset(
    "a an and are as at be been but by can cannot do does enter for forgot from has have here if in incorrect invalid is it its "
    "keep mismatch missing must my new no not of on only optional or our please required reset should show that the their "
    "this to too type use used user was were when will with wrong you your "
    "das dein der des die ein eine ihr ist mit nicht oder und von zu de el en es la las los no para por que su tu un una y "
    "au aux ce du est et le les pas pour sur une votre".split()
)
#: Calls that look a name up; their first text is that name.
LOOKUP = re.compile(r"(?i)(?:^|[._])(?:get|getenv|get_?env|environ|env|config|lookup|getproperty|fetch|setting|option)\Z")
#: Characters of a joined constant that are kept as text.
TEXT_KEPT = 4096
#: Lengths beyond it are not told apart.
LONGEST = 1 << 40

_RUN = re.compile(r"[A-Za-z0-9_$.-]+")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*")
_SIGN = re.compile(r"""(?:["'`]?\]|["'`])?\??[ \t]*+(?P<sign>:=|=>|=(?!=)|:(?![:/]))[ \t]*+""")
_STRING = re.compile(
    r'''(?P<prefix>[rRbBfFuULl@$]{0,2})(?:"""(?P<a>(?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'(?P<b>(?:[^\'\\]|\\.|\'(?!\'\'))*+)\'\'\''''
    r'''|"(?P<c>(?:[^"\\\n]|\\.)*+)"|\'(?P<d>(?:[^\'\\\n]|\\.)*+)\'|`(?P<e>[^`\n]*+)`)''',
    re.DOTALL,
)
_BARE = re.compile(r"[A-Za-z0-9_$][A-Za-z0-9+/_.$~=@-]*+")
_BARE_HEAD = re.compile(r"[A-Za-z0-9_$]")
_SIGNS = re.compile(r"=+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*")
_BLANK = re.compile(r"[ \t]*+")
_SPACE = re.compile(r"(?:[ \t\r\n]|\\\r?\n)*+")
_CALL = re.compile(r"(?:new[ \t]+)?([A-Za-z_$][A-Za-z0-9_$.:]*+)[ \t]*+([(\[])")
_PLUS = re.compile(r"[ \t]*+(?:\+|[ \t]\.\.?(?=[ \t]))[ \t]*+(?:\r?\n[ \t]*+)?")
_ELSE = re.compile(r"[ \t]*+(?:or\b|\|\||\?\?|\?:)[ \t]*+")
_KEYWORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*+[ \t]*+=(?!=)[ \t]*+")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+\r?\n")
#: A type between ``:`` and ``=``, with its brackets.
_TYPE = r"[A-Za-z_$][A-Za-z0-9_$.]*+(?:[\[<][^\n\"'`=;(){}]{0,100}[\]>])?"
_TYPED = re.compile(rf"(?P<type>{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE})*[?*&]?)(?:[ \t]+=(?![=>])|=(?=[ \t]*[\"'`]))[ \t]*")
_TARGET = re.compile(r"([A-Za-z_$][A-Za-z0-9_$.-]*+)(?:[ \t]++=(?![=>])[ \t]*+|=(?=[\"'`]))")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)((?:\s[^<>]*+)?)>")
_CLOSED = re.compile(r"\s*+([^<]*?)\s*</")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][A-Za-z0-9_.:-]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)')""")
_TAG = re.compile(r"<[A-Za-z_][^<>]*+>")


#: Names of writers are none of authorisation.
_AUTHOR = re.compile(r"author(?!i[sz])")


def name_score(name: str) -> float:
    low = _AUTHOR.sub("", name.lower())
    return max((v for k, v in NAME_PARTS.items() if k in low), default=0.0)


def _phrase_score(words: Sequence[str]) -> float:
    """Pass phrases: three words or more, none of a sentence; full score from four on."""
    low = [w.casefold() for w in words]
    if len(set(low)) < 3 or not all(w.isalnum() and len(w) > 1 for w in low) or SENTENCE & set(low):
        return 0.0
    return min(1.0, len(low) / 4)


class Constant:
    """What a value is scored by: its length, the counts of its characters, its text if it is short, its literals."""

    __slots__ = ("counts", "places", "size", "text")

    def __init__(self, size: float, counts: dict[str, float], text: str | None, places: tuple):
        self.size, self.counts, self.text, self.places = size, counts, text, places

    @classmethod
    def of(cls, text: str, start: int, end: int) -> Constant:
        lines = [x.strip() for x in text.split("\n")]
        lines = [x for x in lines if x]
        if len(lines) == 1 or not any(c.isspace() for x in lines for c in x):
            text = "".join(lines)  # of several lines: a key
        return cls(len(text), Counter(text), text if len(text) <= TEXT_KEPT else None, (start, end))

    def __add__(self, other: Constant) -> Constant:
        size = self.size + other.size
        counts = dict(self.counts)
        for c, n in other.counts.items():
            counts[c] = counts.get(c, 0) + n
        if size > LONGEST:
            size, counts = size / 2, {c: n / 2 for c, n in counts.items()}
        short = self.text is not None and other.text is not None and size <= TEXT_KEPT
        return Constant(size, counts, self.text + other.text if short else None, (self.places, other.places))

    def score(self) -> float:
        """0 to 1: bits per character over 3.5, lowered for short values; phrases by their words; 0 for placeholders."""
        n = self.size
        if n < LEAST_VALUE or (self.text is not None and PLACEHOLDER.match(self.text)):
            return 0.0
        if any(c.isspace() for c in self.counts):
            return _phrase_score(self.text.split()) if self.text is not None else 0.0
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c)
        kinds = any(c.isdigit() for c in self.counts) + any(c.isalpha() for c in self.counts) + any(not c.isalnum() for c in self.counts)
        return min(1.0, bits / 3.5) * (0.5 if kinds < 2 and n < 16 else 1.0)


def value_score(value: str) -> float:
    return Constant.of(value, 0, len(value)).score()


def _literals(places: tuple, seen: set[int]) -> Iterator[tuple[int, int]]:
    """The places of all literals below a link; links met before are passed over."""
    todo = [places]
    while todo:
        node = todo.pop()
        if id(node) in seen:
            continue
        seen.add(id(node))
        if isinstance(node[0], tuple):
            todo += node
        else:
            yield node


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost and not overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: A value as read: its span, its literals as (start, end, names in braces are filled in) and names, in order.
Read = tuple[int, int, list]


class _Reader:
    """Reads the value that begins at a place: (end, what it may be, whether it could be read whole)."""

    def __init__(self, text: str):
        self.text = text
        self.bare_until = 0

    def _bare(self, at: int) -> int:
        """Where a bare value ends; one longer than ``TEXT_KEPT`` ends at its first equals signs, as pairs may lie in it."""
        if at >= self.bare_until or not _BARE_HEAD.match(self.text, at):
            bare = _BARE.match(self.text, at)
            if not bare:
                return at
            self.bare_until = bare.end()
        end = self.bare_until
        if end - at > TEXT_KEPT:
            sign = _SIGNS.search(self.text, at, end)
            return sign.end() if sign else end
        return end

    def value(self, at: int) -> tuple[int, list[Read]]:
        found: list[Read] = []
        while True:
            end, more = self._alternative(at)
            found += more
            other = _ELSE.match(self.text, end)
            if not other:
                return end, found
            at = other.end()

    def _alternative(self, at: int) -> tuple[int, list[Read]]:
        text = self.text
        skipped = _SPACE.match(text, at).end()
        if skipped < len(text) and (text[skipped] in "([" or _STRING.match(text, skipped)):
            at = skipped  # a literal or bracket of the next line
        if at < len(text) and text[at] in "([":
            while at < len(text) and text[at] in "([":
                at = _SPACE.match(text, at + 1).end()
            return self._listed(at, False)
        call = _CALL.match(text, at)
        if call:
            at = _SPACE.match(text, call.end()).end()
            return self._listed(at, bool(LOOKUP.search(call[1])))
        end, parts = self._joined(at, False)
        return end, [(at, end, parts)] if parts else []

    def _listed(self, at: int, lookup: bool) -> tuple[int, list[Read]]:
        """What stands in brackets: joined literals and names between commas, the first left out if it is looked up."""
        text, found, first = self.text, [], True
        while at < len(text):
            word = _KEYWORD.match(text, at)
            at = word.end() if word else at
            end, parts = self._joined(at, True)
            # a bare value in brackets is a name or number
            plain = [p for p in parts if not isinstance(p, str)]
            if parts and (plain or len(parts) > 1) and not (first and lookup):
                found.append((at, end, parts))
            first = False
            end = _SPACE.match(text, end).end()
            if end >= len(text) or text[end] != "," or end == at:
                return (_closed(text, end), found)
            at = _SPACE.match(text, end + 1).end()
        return at, found

    def _joined(self, at: int, lines: bool) -> tuple[int, list]:
        """Literals and names joined by ``+`` or nothing; in brackets over several lines."""
        text, parts, end = self.text, [], at
        blank = _SPACE if lines else _BLANK
        while True:
            string = _STRING.match(text, at)
            if string:
                parts.append((string.start(string.lastgroup), string.end(string.lastgroup), bool(set(string["prefix"]) & set("fF$"))))
                end = string.end()
                at = blank.match(text, end).end()
                if _STRING.match(text, at):
                    continue
            else:
                name = _IDENTIFIER.match(text, at)
                stop = (name.end() if name else at) if lines or parts else self._bare(at)
                if stop == at:
                    return end, [*parts, ""] if parts else []
                # a name that may be known, else a literal without quotes
                parts.append(text[at:stop] if name and name.end() == stop else (at, stop, False))
                end = stop
            plus = _PLUS.match(text, blank.match(text, end).end() if lines else end)
            if not plus:
                return end, parts
            at = plus.end()


def _closed(text: str, at: int) -> int:
    while at < len(text) and text[at] in ")]":
        at += 1
    return at


def _block(text: str, at: int, line: int) -> tuple[int, int] | None:
    """The span of the lines behind ``at`` that are indented deeper than the line that begins at ``line``."""
    depth = _BLANK.match(text, line).end() - line
    start = end = None
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        first = _BLANK.match(text, at).end()
        if text[first:stop].strip():
            if first - at <= depth:
                break
            start = first if start is None else start
            end = first + len(text[first:stop].rstrip())
        at = stop + 1
    return None if start is None else (start, end)


def _marked_up(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of XML elements with text only, and of attributes ``key`` or ``name`` beside ``value``."""
    for tag in _TAG.finditer(text):
        pairs = {m[1].lower(): m for m in _ATTRIBUTE.finditer(text, tag.start(), tag.end())}
        key = next((pairs[k] for k in ("key", "name", "id") if k in pairs), None)
        value = next((pairs[k] for k in ("value", "content") if k in pairs), None)
        name = (key[2] or key[3] or "") if key else ""
        if name and value:
            yield name, *value.span(2 if value[2] is not None else 3)
        element = _ELEMENT.fullmatch(text, tag.start(), tag.end())
        if element:
            names = [x for x in (element[1], name) if name_score(x)]
            inner = _CLOSED.match(text, tag.end()) if names else None
            if inner:
                yield max(names, key=name_score), *inner.span(1)


def lexed_spans(text: str) -> list[tuple[int, int, int, str, float]]:
    """(start, kind, end, name, score) of values that are secrets by their target's name.

    Constants are carried along in the order of the text; a later assignment to
    the same name replaces the earlier one.  A value that was carried along is
    reported where it is used, and its literals where they stand.
    """
    found = []
    constants: dict[str, Constant] = {}
    reported: set[int] = set()
    reader = _Reader(text)

    def judge(name: str, value: Constant | None, kind: int, start: int, end: int) -> bool:
        score = name_score(name)
        score = math.sqrt(score * value.score()) if score and value else 0.0
        if score < SCORE or start >= end:
            return False
        found.append((start, kind, end, name, score))
        return True

    def resolve(parts: list) -> tuple[Constant | None, list[Constant]]:
        """What the parts make together, and the constants among them; nothing where a name is unknown."""
        value, carried = None, []
        for p in parts:
            if isinstance(p, str):
                one = constants.get(p)
                if one is None and len(parts) == 1:
                    return None, []
                if one is None:
                    return None, carried
                carried.append(one)
            else:
                inner = text[p[0] : p[1]]
                one = Constant.of(re.sub(r"\{[^{}]*\}", "", inner) if p[2] else inner, p[0], p[1])
            value = one if value is None else value + one
        return value, carried

    chained = 0
    for run in _RUN.finditer(text):
        named = _NAME.search(run[0]) if run.start() >= chained else None
        sign = _SIGN.match(text, run.end()) if named else None
        if not sign:
            continue
        names, at = [named[0]], sign.end()
        block = _BLOCK.match(text, at) if sign["sign"] == ":" and name_score(names[0]) else None
        if block:
            span = _block(text, block.end(), text.rfind("\n", 0, run.start()) + 1)
            if span:
                judge(names[0], Constant.of(text[slice(*span)], *span), 3, *span)
            continue
        typed = _TYPED.match(text, at) if sign["sign"] == ":" else None
        at = typed.end() if typed else at
        while target := _TARGET.match(text, at):
            names.append(target[1])
            at = chained = target.end()
        _, values = reader.value(at)
        any_found = False
        kept = None
        for start, end, parts in values:
            alone = len(parts) == 1
            value, carried = resolve(parts)
            if value is None and alone and isinstance(parts[0], str):
                value = Constant.of(parts[0], start, end)  # an unknown name may be a bare value
            kept = value if len(values) == 1 else None
            if alone and not isinstance(parts[0], str):
                start, end = parts[0][:2]
                inner = text[start:end]
                start, end = start + len(inner) - len(inner.lstrip()), end - len(inner) + len(inner.rstrip())
                start = min(start, end)
            for name in names:
                if judge(name, value, 4 if carried else 3, start, end):
                    any_found = True
                    score = found[-1][4]
                    for one in carried:
                        found.extend((a, 5, b, name, score) for a, b in _literals(one.places, reported) if a < b)
        for name in names:
            if kept is None:
                constants.pop(name, None)
            else:
                constants[name] = kept
        if typed and not any_found:  # it may be the value, with an assignment behind
            judge(names[0], Constant.of(typed["type"], *typed.span("type")), 3, *typed.span("type"))
    for name, start, end in _marked_up(text) if "<" in text else ():
        judge(name, Constant.of(text[start:end], start, end), 3, start, end)
    return list({x[:3]: x for x in reversed(found)}.values())[::-1]


def scan_text(text: str | None) -> list[dict]:
    """Every span of one text: kind, start, end, name, score, by start, then kind."""
    text = text or ""
    rows = [{"kind": KINDS[k], "start": s, "end": e, "name": None, "score": 1.0} for s, k, e in base_spans(text)]
    if "=" in text or ":" in text or "</" in text:
        rows += [{"kind": KINDS[k], "start": s, "end": e, "name": n, "score": v} for s, k, e, n, v in lexed_spans(text)]
        rows.sort(key=lambda r: (r["start"], KINDS.index(r["kind"]), r["end"]))
    return rows


SPANS = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def _scan(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in columns:
        yield pd.Series([scan_text(t) for t in texts], dtype=object)


def _redact(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in columns:
        yield texts.map(redact_text)


def redact_text(text: str | None) -> str | None:
    """The text with its secret spans replaced by ``[SECRET]``; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for r in scan_text(text):
        if r["start"] >= at:
            out += [text[at : r["start"]], "[SECRET]"]
        at = max(at, r["end"])
    return "".join([*out, text[at:]])


def spans_of(text: Column) -> Column:
    return F.pandas_udf(_scan, SPANS)(text)


def redacted(text: Column) -> Column:
    return F.pandas_udf(_redact, "string")(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its ``spans``, a row per document row; an empty table gives an empty one."""
    return docs.select("doc_id", spans_of(F.col("text")).alias("spans"))


def digest(spans: list, base_only: bool) -> str:
    kinds = KINDS[:3] if base_only else KINDS
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in kinds)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets``."""
    def joined(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
