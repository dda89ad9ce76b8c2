"""Text expressions.  All run on batch and on streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqspark import values as V

INNER_SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD_OR_GAP = r"\p{L}+|\P{L}+"


def trim_space(c: Column) -> Column:
    """Cut white space of any kind (also Unicode) off both ends.

    Only the ends of the text are looked at, which a pattern would not do.
    """
    return F.btrim(c, F.lit(V.WHITE_SPACE))


def clean_space(c: Column) -> Column:
    """Turn each run of white space into one space and trim (F1).

    After the first step only spaces are left to trim.
    """
    return F.trim(F.regexp_replace(c, INNER_SPACE, " "))


def title_case(c: Column) -> Column:
    """Upper-case the letter after any non-letter, lower-case the rest (F2)."""
    words = F.regexp_extract_all(c, F.lit(WORD_OR_GAP), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), "")


def set_case(c: Column, case: str) -> Column:
    """``case`` is ``title``, ``upper``, ``lower`` or ``none``."""
    by_name = {"title": title_case, "upper": F.upper, "lower": F.lower, "none": lambda x: x}
    if case.lower() not in by_name:
        raise ValueError(f"unknown case {case!r}; use one of {sorted(by_name)}")
    return by_name[case.lower()](c)


def blank_to_null(c: Column) -> Column:
    return F.when(trim_space(c) != "", c)


def na_to_null(c: Column, tokens: Iterable[str] = V.NA_TOKENS) -> Column:
    """Missing-value texts become NULL."""
    return F.when(~c.isin(*tokens), c)


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """Like ``regexp_extract`` but NULL where the pattern does not match (F8)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def truncate(c: Column, length: int, ellipsis: str = "…", keep: int | None = None) -> Column:
    """Cut a text longer than ``length`` to ``keep`` characters plus ellipsis."""
    keep = length - 3 if keep is None else keep
    cut = F.concat(F.substring(c, 1, keep), F.lit(ellipsis))
    return F.when(F.char_length(c) > length, cut).otherwise(c)


def percent_text(c: Column, decimals: int = 1) -> Column:
    """``12.34`` as ``12.3%``."""
    return F.format_string(f"%.{decimals}f%%", c)


def item_count(c: Column, separators: str = V.LIST_SEPARATORS) -> Column:
    """Number of non-blank items in a packed list; 0 for NULL."""
    items = F.split(F.coalesce(c.cast("string"), F.lit("")), separators)
    return F.size(F.filter(items, lambda x: trim_space(x) != ""))


def terms_found(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur in the text, case-folded."""
    low = F.lower(c.cast("string"))
    hits = [F.coalesce(F.contains(low, F.lit(t.lower())).cast("int"), F.lit(0)) for t in terms]
    return sum(hits[1:], hits[0])


def cache_key(c: Column) -> Column:
    """Key under which equal questions meet."""
    return F.concat(F.lit("q::"), F.lower(trim_space(c)))


def shape(c: Column) -> Column:
    """Letters to ``A``, digits to ``9``, other characters kept."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "A"), r"\p{Nd}", "9")
