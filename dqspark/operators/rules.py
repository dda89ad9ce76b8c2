"""Detection rules: each is one boolean SQL expression over a row.

A rule is text, so it can be stored, read back and checked before any job
runs; nothing but Spark SQL ever executes it.  Factories below write the text
of the known kinds of rules.  Rules that need a statistic take it as a number;
:func:`suggest_rules` fits them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from threading import RLock

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.functions.coerce import NUMBER_SUFFIX
from dqspark.functions.flagbits import flag_value
from dqspark.functions.text import WORD_OR_GAP, shape
from dqspark.operators import stats
from dqspark.operators.columns import col, columns_of, family, quote


@dataclass(frozen=True)
class Rule:
    """A detection rule; ``flag_value`` 0 means "not numbered yet"."""

    detection_code: str
    columns: tuple[str, ...]
    explanation: str
    flag_value: int = 0
    category: str = V.UNKNOWN_CATEGORY
    severity: str = V.DEFAULT_SEVERITY
    test_description: str = ""
    safety_notes: str = ""


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(name: str) -> str:
    c = quote(name)
    suffixed = f"typeof({c}) = 'string' AND {_text(name)} RLIKE r'{NUMBER_SUFFIX}'"
    # NaN compares as larger than all numbers; here it is a missing value
    return f"CASE WHEN {suffixed} THEN NULL ELSE nanvl(try_cast({c} AS DOUBLE), CAST(NULL AS DOUBLE)) END"


def _text(name: str) -> str:
    return f"cast({quote(name)} AS STRING)"


def _missing(name: str) -> str:
    """NULL or NaN, whatever the type of the column."""
    c = quote(name)
    return f"({c} IS NULL OR (typeof({c}) IN ('double', 'float') AND {_text(name)} = 'NaN'))"


def _trim(text: str) -> str:
    spaces = "".join(c if c == " " else f"\\u{ord(c):04x}" for c in V.WHITE_SPACE)
    return f"btrim({text}, '{spaces}')"


def _trimmed(name: str) -> str:
    return _trim(_text(name))


def _time(name: str) -> str:
    return f"try_cast({quote(name)} AS TIMESTAMP_NTZ)"


def _texts(values: Iterable[str]) -> str:
    return ", ".join(sql_text(v) for v in values)


# --- kinds of rules ---------------------------------------------------------


def both_true(a: str, b: str, true_texts: Sequence[str] = V.TRUE_TEXTS) -> Rule:
    """Two exclusive booleans are both true."""
    test = " AND ".join(f"lower({_trimmed(c)}) IN ({_texts(true_texts)})" for c in (a, b))
    return Rule(test, (a, b), f"{a} and {b} are both true", category="consistency", severity="high")


def negative(name: str) -> Rule:
    """Negative number where none is allowed."""
    return Rule(f"{_number(name)} < 0", (name,), f"{name} is negative", category="validity", severity="high")


def starts_after_end(start: str, end: str) -> Rule:
    """Start later than end."""
    return Rule(f"{_time(start)} > {_time(end)}", (start, end), f"{start} is after {end}",
                category="chronology", severity="high")


def count_mismatch(count: str, items: str, separators: str = V.LIST_SEPARATORS) -> Rule:
    """Count column that differs from the number of listed items.

    A missing or bad count is 0, a fraction is cut toward zero.
    """
    counted = f"coalesce(try_cast({_number(count)} AS BIGINT), 0)"
    listed = (
        f"size(filter(split(coalesce({_text(items)}, ''), r'{separators}'), "
        f"x -> {_trim('x')} <> ''))"
    )
    return Rule(f"{counted} <> {listed}", (count, items), f"{count} differs from the number of items in {items}",
                category=V.CROSS_FIELD_CATEGORY, severity="high",
                test_description=f"rows where {count} is not the number of items in {items}",
                safety_notes="missing values count as 0 and as no item")


def blank(name: str) -> Rule:
    """Missing or only white space."""
    return Rule(f"{_missing(name)} OR {_trimmed(name)} = ''", (name,), f"{name} is missing or blank",
                category="completeness")


def both_chosen(a: str, b: str, chosen: Sequence[str]) -> Rule:
    """Two exclusive options are both chosen."""
    test = " AND ".join(f"{_trimmed(c)} IN ({_texts(chosen)})" for c in (a, b))
    return Rule(test, (a, b), f"{a} and {b} are both chosen", category="consistency", severity="high")


def conflicting_terms(name: str, terms: Sequence[str]) -> Rule:
    """One text that holds two or more conflicting terms."""
    hits = " + ".join(f"cast(contains(lower({_text(name)}), {sql_text(t.lower())}) AS INT)" for t in terms)
    return Rule(f"{hits} >= 2", (name,), f"{name} holds conflicting terms", category="consistency", severity="high")


def above(name: str, limit: float) -> Rule:
    """Larger than a limit, e.g. ten times the upper quartile."""
    return Rule(f"{_number(name)} > {float(limit)!r}D", (name,), f"{name} is extremely high", category="outlier")


def outside(name: str, low: float, high: float) -> Rule:
    """Outside two fences."""
    x = _number(name)
    return Rule(f"{x} < {float(low)!r}D OR {x} > {float(high)!r}D", (name,), f"{name} is an outlier",
                category="outlier")


def unusual_text(name: str, special: str = V.SPECIAL_CHARACTERS) -> Rule:
    """Mixed case, two spaces in a row or a special character."""
    c = _text(name)
    title = f"array_join(transform(regexp_extract_all({c}, r'{WORD_OR_GAP}', 0), x -> initcap(x)), '')"
    # a small letter that begins a word or a capital inside one tells early that
    # the text is not in title case; only other texts are compared in full
    not_title = f"({c} RLIKE r'(?<!\\p{{L}})[a-z]|(?<=\\p{{L}})[A-Z]' OR {c} <> {title})"
    mixed = f"(char_length({c}) > 1 AND {c} <> upper({c}) AND {c} <> lower({c}) AND {not_title})"
    marks = "[" + re.escape(special) + "]"
    return Rule(f"{mixed} OR contains({c}, '  ') OR {c} RLIKE r'{marks}'", (name,), f"{name} is unusual text",
                category="format", severity="low")


def mostly_missing(names: Sequence[str], share: float = 0.2) -> Rule:
    """More than ``share`` of the columns are missing."""
    total = " + ".join(f"cast({_missing(c)} AS INT)" for c in names)
    return Rule(f"({total}) > {float(len(names) * share)!r}D", tuple(names),
                f"more than {share:.0%} of the columns are missing", category="completeness")


def status_conflict(status: str, value: str, field: str) -> Rule:
    """A status that forbids a value in another field."""
    return Rule(f"lower({_trimmed(status)}) = {sql_text(value.lower())} AND NOT {_missing(field)}",
                (status, field), f"{field} is set although {status} is {value}", category="consistency",
                severity="high")


def duration_mismatch(start: str, end: str, duration: str, seconds_per_unit: float = 1.0,
                      tolerance: float = 0.0) -> Rule:
    """Duration that is not end minus start."""
    span = f"cast(timestampdiff(MICROSECOND, {_time(start)}, {_time(end)}) AS DOUBLE) / {1e6 * seconds_per_unit!r}D"
    return Rule(f"abs({span} - {_number(duration)}) > {float(tolerance)!r}D", (start, end, duration),
                f"{duration} is not {end} minus {start}", category="chronology", severity="high")


def total_mismatch(total: str, parts: Sequence[str], tolerance: float = 0.0) -> Rule:
    """Total that is not the sum of its parts."""
    added = " + ".join(_number(p) for p in parts)
    return Rule(f"abs({_number(total)} - ({added})) > {float(tolerance)!r}D", (total, *parts),
                f"{total} is not the sum of {', '.join(parts)}", category="arithmetic", severity="high")


def average_mismatch(average: str, total: str, count: str, tolerance: float = 0.0) -> Rule:
    """Average that is not total by count."""
    ratio = f"try_divide({_number(total)}, {_number(count)})"
    return Rule(f"abs({_number(average)} - {ratio}) > {float(tolerance)!r}D", (average, total, count),
                f"{average} is not {total} / {count}", category="arithmetic", severity="high")


def percentage_mismatch(percent: str, part: str, whole: str, tolerance: float = 0.0) -> Rule:
    """Percentage that is not part of whole."""
    ratio = f"100D * try_divide({_number(part)}, {_number(whole)})"
    return Rule(f"abs({_number(percent)} - {ratio}) > {float(tolerance)!r}D", (percent, part, whole),
                f"{percent} is not {part} in % of {whole}", category="arithmetic", severity="high")


def rare_format(name: str, common_shapes: Sequence[str]) -> Rule:
    """Text whose character shape is none of the common ones."""
    c = f"regexp_replace(regexp_replace({_text(name)}, r'\\p{{L}}', 'A'), r'\\p{{Nd}}', '9')"
    test = f"{c} NOT IN ({_texts(common_shapes)})" if common_shapes else f"{c} IS NOT NULL"
    return Rule(test, (name,), f"{name} has a rare format", category="format", severity="low")


def matching_nothing(names: Sequence[str], description: str) -> Rule:
    """Stands in for a rule that cannot be used."""
    return Rule("false", tuple(names), f"Fallback for {description}", test_description="selects no rows")


# --- rules that need statistics ---------------------------------------------


def common_shapes(df: DataFrame, name: str, min_share: float = 0.05) -> list[str]:
    """Character shapes with at least ``min_share`` of the non-missing rows.

    There are at most 1 / min_share of them, however many shapes occur.
    """
    shapes = df.select(shape(col(name).cast("string")).alias("shape")).where("shape IS NOT NULL")
    counted = shapes.groupBy("shape").agg(F.count("*").alias("n"))
    n = shapes.count()
    return sorted(r["shape"] for r in counted.where(F.col("n") >= n * min_share).select("shape").collect())


def cross_table_totals(
    header: DataFrame, lines: DataFrame, header_key: str, lines_key: str, total: str, amount: str,
    tolerance: float = 0.0, out: str = "total_mismatch",
) -> DataFrame:
    """Header rows whose total is not the sum of their lines (R15 across tables).

    Lines are added up per key before they meet the header.
    """
    sums = lines.groupBy(col(lines_key).alias("__key")).agg(F.sum(col(amount).cast("double")).alias("__sum"))
    joined = header.join(sums, header[quote(header_key)] == sums["__key"], "left")
    off = F.abs(col(total).cast("double") - F.coalesce(F.col("__sum"), F.lit(0.0))) > tolerance
    return joined.withColumn(out, F.coalesce(off, F.lit(False))).withColumnRenamed("__sum", "lines_sum").drop("__key")


# --- rules from column names ------------------------------------------------


def named_like(names: Iterable[str], parts: Iterable[str]) -> list[str]:
    """Names that contain one of the parts, whatever the case."""
    parts = [p.lower() for p in parts]
    return [c for c in names if any(p in c.lower() for p in parts)]


def count_list_pairs(df: DataFrame, count_names=V.COUNT_NAMES, list_names=V.LIST_NAMES) -> list[tuple[str, str]]:
    """Count columns and the list columns that share their stem.

    ``items_count`` and ``num_items`` go with ``items_list`` and ``items``, and
    ``layovers`` with ``layover_locations``: what is left of the count column
    begins the name of the list column, and only list words may follow.
    """

    def singular(word: str) -> str:
        return word[:-1] if len(word) > 3 and word.endswith("s") else word

    def words(name: str) -> list[str]:
        return [singular(w) for w in re.split(r"[^a-z0-9]+", name.lower()) if w]

    counting, listing = {singular(w) for w in count_names}, {singular(w) for w in list_names}
    pairs = []
    for c in df.columns:
        parts = words(c)
        stem = [w for w in parts if w not in counting]
        if not stem or (family(df.schema[c].dataType) != "numeric" and len(stem) == len(parts)):
            continue
        for other in columns_of(df, "text"):
            named = words(other)
            rest = named[len(stem):]
            plural_or_list = rest or other.lower().endswith("s")
            if other != c and named[: len(stem)] == stem and set(rest) <= listing and plural_or_list:
                pairs.append((c, other))
    return pairs


def rules_from_names(df: DataFrame) -> list[Rule]:
    """Rules that column names call for and that need no statistic."""
    rules: list[Rule] = []
    for parts, chosen in V.EXCLUSIVE_OPTIONS:
        matching = named_like(df.columns, parts)
        if len(matching) >= 2:
            rules.append(both_chosen(matching[0], matching[1], chosen))
    for parts, terms in V.CONFLICTING_TERMS:
        rules += [conflicting_terms(c, terms) for c in named_like(df.columns, parts)]
    rules += [negative(c) for c in named_like(columns_of(df, "numeric"), V.NON_NEGATIVE_NAMES)]
    rules += [count_mismatch(a, b) for a, b in count_list_pairs(df)]
    return rules


def rules_from_values(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> list[Rule]:
    """Outlier and extreme-value rules of numeric columns."""
    names = columns_of(df, "numeric") if columns is None else list(columns)
    found = stats.quantiles(df, {c: [0.25, 0.75] for c in names}, approx)
    rules = []
    for c in names:
        q1, q3 = found[c]
        if q1 is not None and q3 > q1:
            reach = 1.5 * (q3 - q1)
            rules.append(outside(c, q1 - reach, q3 + reach))
        if q3 is not None and named_like([c], V.EXTREME_NAMES):
            rules.append(above(c, 10 * q3))
    return rules


def suggest_rules(df: DataFrame, approx: bool = False) -> list[Rule]:
    """All rules that names and values of a table call for, without repeats."""
    rules = rules_from_names(df) + rules_from_values(df, approx=approx) + [mostly_missing(df.columns)]
    return list({r.detection_code: r for r in rules}.values())


# --- checks and numbering ---------------------------------------------------


def numbered(rules: Sequence[Rule]) -> list[Rule]:
    """Rules that have a flag keep it, the others take the free ones 1, 2, 4, ... in their order."""
    kept = [r.flag_value for r in rules if r.flag_value]
    wrong = sorted(f for f in kept if f < 0 or f & (f - 1) or f >= 1 << V.MAX_FLAGS)
    if wrong or len(set(kept)) < len(kept):
        raise ValueError(f"flags must be different powers of two below 2^{V.MAX_FLAGS}: {sorted(kept)}")
    if len(rules) > V.MAX_FLAGS:
        raise ValueError(f"a status holds at most {V.MAX_FLAGS} flags, not {len(rules)}")
    free = (f for f in map(flag_value, range(V.MAX_FLAGS)) if f not in set(kept))
    return [r if r.flag_value else replace(r, flag_value=next(free)) for r in rules]


_ONE_AT_A_TIME = RLock()


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Analyse rules so that a value they cannot be applied to gives NULL and no error.

    Whether a cast or division may fail is settled when an expression is
    analysed, so one bad value does not stop the other rules later.  The setting
    is the session's, so threads take turns: none puts back what another has set.
    """
    key = "spark.sql.ansi.enabled"
    with _ONE_AT_A_TIME:
        before = spark.conf.get(key)
        spark.conf.set(key, "false")
        try:
            yield
        finally:
            spark.conf.set(key, before)


def _forbidden(df: DataFrame, text: str) -> str:
    """Why a parsed rule is refused: functions that are not on the list, subqueries; else empty.

    Looks at the parsed expression, not at words of the text, so a column may
    be called ``from`` and texts may hold anything.
    """
    todo = [df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(text)]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if "Subquery" in kind or kind in ("Exists", "ListQuery"):
            return "subqueries are not allowed"
        if kind == "UnresolvedFunction":
            name = ".".join(_each(node.nameParts())).lower()
            if name not in V.RULE_FUNCTIONS:
                return f"function {name} is not allowed"
        todo += _each(node.children())
    return ""


def _each(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def check_rule(df: DataFrame, rule: Rule) -> str:
    """Empty when the rule can be used, else why not.

    The text must be one boolean row expression over the rule's own columns,
    with functions of a fixed list only: it is analysed as the condition of a
    filter over a one-row table of just these columns, which refuses
    aggregates, windows and generators.
    """
    lost = [c for c in rule.columns if c not in df.columns]
    if lost:
        return f"no such column: {', '.join(lost)}"
    fields = [df.schema[c] for c in rule.columns]
    listed = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {quote(f.name)}" for f in fields)
    try:
        refused = _forbidden(df, rule.detection_code)
        if refused:
            return refused
        with lenient(df.sparkSession):
            df.sparkSession.sql(f"SELECT {listed or 1}").where(F.expr(rule.detection_code)).schema
    except (AnalysisException, ParseException) as error:
        return str(error).split("SQLSTATE")[0].strip()
    return ""


def fallback(rule: Rule) -> Rule:
    """What to run instead of an unusable rule."""
    pair = rule.category.lower().strip() == V.CROSS_FIELD_CATEGORY and len(rule.columns) == 2
    other = count_mismatch(*rule.columns) if pair else matching_nothing(rule.columns, rule.explanation)
    return replace(other, flag_value=rule.flag_value, category=rule.category, severity=rule.severity)


