"""Equi-joins in which missing keys meet, and left-deep chains of them.

Adaptive execution splits a skewed key on the side whose rows are all kept, but
not on the side that is looked up, and no key of a full join.  A step with
``hot_rows`` therefore looks for the heavy keys of both sides first (NULL among
them, by an approximate top-k of the keys' hashes) and joins these by parts: the
rows of a hot key are dealt to so many parts on either side that a part has
about ``hot_rows`` rows, and every left part meets every right part.  All other
keys stay an ordinary join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.operators.columns import col

JOIN_TYPES = ("left", "inner", "right", "outer")


@dataclass(frozen=True)
class JoinSpec:
    """One step of a chain: join ``secondary_table`` to what is there so far."""

    secondary_table: str
    primary_key: str
    secondary_key: str
    join_type: str = "left"
    selected_columns: Sequence[str] | None = field(default=None)
    #: Rows of one key on one side beyond which they are split; None leaves all keys to Spark.
    hot_rows: int | None = None


def _common_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Give both keys one type: numbers are widened, other mixes become text; decimals are left alone."""
    a, b = left.schema[left_key].dataType, right.schema[right_key].dataType
    if a == b:
        return left, right
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if any(isinstance(t, T.DecimalType) for t in (a, b)):
            return left, right  # compared by :func:`_exact_keys`
        fractional = any(isinstance(t, (T.DoubleType, T.FloatType)) for t in (a, b))
        target = "double" if fractional else "bigint"
    else:
        target = "string"
    left = left if a.simpleString() == target else left.withColumn(left_key, col(left_key).cast(target))
    right = right if b.simpleString() == target else right.withColumn(right_key, col(right_key).cast(target))
    return left, right


_WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def common_decimal(a: T.DataType, b: T.DataType) -> T.DecimalType | None:
    """The decimal that holds all values of two decimal or whole types, if there is one."""
    sizes = []
    for t in (a, b):
        if isinstance(t, T.DecimalType):
            sizes.append((t.precision - t.scale, t.scale))
        elif type(t) in _WHOLE_DIGITS:
            sizes.append((_WHOLE_DIGITS[type(t)], 0))
        else:
            return None
    whole, scale = max(w for w, _ in sizes), max(s for _, s in sizes)
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None


def number_digits(c: Column, dtype: T.DataType) -> Column:
    """Sign, digits and place of the point of a number, the same text for equal numbers of any type.

    A double stands for the shortest decimal that reads as it, so 0.1 is 0.1;
    NaN is missing.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    text = c.cast("string")
    mantissa = F.split_part(F.ltrim(text, F.lit("-")), F.lit("E"), F.lit(1))
    exponent = F.coalesce(F.try_to_number(F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit("")), F.lit("S999")), F.lit(0))
    whole = F.split_part(mantissa, F.lit("."), F.lit(1))
    digits = F.concat(whole, F.split_part(mantissa, F.lit("."), F.lit(2)))
    led = F.ltrim(digits, F.lit("0"))
    place = F.length(whole) - (F.length(digits) - F.length(led)) + exponent.cast("int")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    return (
        F.when(F.contains(text, F.lit("Inf")), text)
        .when(text.isNotNull() & (led == ""), "0")
        .otherwise(F.concat(sign, F.rtrim(led, F.lit("0")), F.lit("e"), place.cast("string")))
    )


EXACT_LEFT, EXACT_RIGHT = "__exact_left", "__exact_right"


def _exact_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[Column, Column] | None:
    """What both keys are compared by where their own types would not tell numbers apart, else nothing.

    Decimals of two kinds and whole numbers meet in the decimal that holds both,
    or by their digits where none does, and so do decimals and fractions; a bigint
    and a fraction meet by their digits.
    """
    a, b = left.schema[left_key].dataType, right.schema[right_key].dataType
    numbers = isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
    if a != b and numbers and any(isinstance(t, T.DecimalType) for t in (a, b)):
        both = common_decimal(a, b)
        if both is not None:
            return col(left_key).cast(both), col(right_key).cast(both)
        return number_digits(col(left_key), a), number_digits(col(right_key), b)
    fractions = [isinstance(t, (T.DoubleType, T.FloatType)) for t in (a, b)]
    if not (any(fractions) and any(isinstance(t, T.LongType) for t in (a, b))):
        return None

    def digits(c: Column, fraction: bool) -> Column:
        if not fraction:
            return c.cast("string")
        number = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        whole = (number == F.floor(number)) & (number >= -(2.0**63)) & (number < 2.0**63)
        return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(number.cast("string"))

    return digits(col(left_key), fractions[0]), digits(col(right_key), fractions[1])


def _secondary_names(left: DataFrame, names: Sequence[str], table: str) -> dict[str, str]:
    """Names of the secondary columns; a clash gets the table's name behind it."""
    taken, result = set(left.columns), {}
    for name in names:
        new = name if name not in taken else f"{name}_{table}"
        while new in taken:
            new += "_"
        taken.add(new)
        result[name] = new
    return result


def join_tables(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """One null-safe equi-join.

    Keys of one name become one column, taken from whichever side has the row;
    keys of two names are both kept.
    """
    if spec.join_type not in JOIN_TYPES:
        raise ValueError(f"join_type must be one of {JOIN_TYPES}")
    chosen = spec.selected_columns
    if chosen is None:
        chosen = [c for c in right.columns if c != spec.secondary_key]
    right = right.select(*[col(c) for c in dict.fromkeys([spec.secondary_key, *chosen])])
    exact = _exact_keys(left, right, spec.primary_key, spec.secondary_key)
    if exact:  # a number as double does not tell large whole numbers apart: join by their digits
        left, right = left.withColumn(EXACT_LEFT, exact[0]), right.withColumn(EXACT_RIGHT, exact[1])
    left, right = _common_keys(left, right, spec.primary_key, spec.secondary_key)
    one_key = spec.primary_key == spec.secondary_key
    names = _secondary_names(left, [c for c in right.columns if c != EXACT_RIGHT and not (one_key and c == spec.secondary_key)],
                             spec.secondary_table)
    right_key = "__right_key" if one_key else names[spec.secondary_key]
    right = right.withColumnsRenamed({**names, **({spec.secondary_key: right_key} if one_key else {})})

    on = (EXACT_LEFT, EXACT_RIGHT) if exact else (spec.primary_key, right_key)
    join = _null_safe_join if spec.hot_rows is None else partial(_split_join, hot_rows=spec.hot_rows)
    joined = join(left, right, *on, spec.join_type).drop(EXACT_LEFT, EXACT_RIGHT)
    if one_key:
        key = _one_key(joined.schema, spec.primary_key, right_key, spec.join_type)
        joined = joined.withColumn(spec.primary_key, key).drop(right_key)
    return joined


def _one_key(schema: T.StructType, left_key: str, right_key: str, how: str) -> Column:
    """The key of whichever side has the row, its value never changed.

    Where no type holds the numbers of both sides, a left or inner join keeps the
    left key, a right join the right one, and a full join gives texts.
    """
    a, b = schema[left_key].dataType, schema[right_key].dataType
    first, second = col(left_key), col(right_key)
    if a != b and any(isinstance(t, T.DecimalType) for t in (a, b)):
        both = common_decimal(a, b)
        if both is None and how != "outer":
            return second if how == "right" else first
        first, second = (c.cast(both or "string") for c in (first, second))
    return F.coalesce(first, second)


HOT_HASH, SALT_LEFT, SALT_RIGHT = "__hot", "__part_left", "__part_right"
#: Keys a side can have with more than a 64th of its rows, and the counters kept to find them.
HOT_KEYS, HOT_COUNTERS = 64, 4096
MOST_PARTS = 10_000


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> dict[int, int]:
    """Hashes of keys with about ``hot_rows`` rows or more, with their rows; NULL is a key.

    A mergeable sketch of bounded size reads the side once, without a shuffle;
    what it misjudges changes the work of some task, never the result.
    """
    top = F.call_function("approx_top_k", F.xxhash64(col(key)), F.lit(HOT_KEYS), F.lit(HOT_COUNTERS))
    found = df.agg(top.alias("top")).first()["top"] or []
    return {r["item"]: r["count"] for r in found if r["count"] >= hot_rows}


def _parts_of(found: Mapping[int, int], hashes: Sequence[int], hot_rows: int) -> Column:
    """Parts of a key's rows on one side, by the hash of the key."""
    listed = [(h, min(MOST_PARTS, -(-found[h] // hot_rows))) for h in hashes if found.get(h, 0) > hot_rows]
    if not listed:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in listed for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(HOT_HASH)), F.lit(1))


def _dealt(df: DataFrame, own: Column, other: Column, own_name: str, other_name: str) -> DataFrame:
    """Rows dealt to the parts of their key, one copy for each part of the other side.

    The part comes from the row's values and its partition, so a task that runs
    again deals alike, and copies of one row spread as far as their partitions.
    """
    plain = [col(f.name) for f in df.schema if not _holds_map(f.dataType)]
    part = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), own).cast("int")
    return df.withColumn(own_name, part).withColumn(other_name, F.explode(F.sequence(F.lit(0), other - 1)))


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype)
    return isinstance(dtype, (T.MapType, T.VariantType)) or (isinstance(dtype, T.ArrayType) and _holds_map(dtype.elementType))


def _split_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, hot_rows: int) -> DataFrame:
    """The null-safe join with the hot keys of either side joined by parts."""
    hot_left, hot_right = hot_keys(left, left_key, hot_rows), hot_keys(right, right_key, hot_rows)
    hashes = sorted({*hot_left, *hot_right})
    if not hashes:
        return _null_safe_join(left, right, left_key, right_key, how)
    left = left.withColumn(HOT_HASH, F.xxhash64(col(left_key)))
    right = right.withColumn(HOT_HASH, F.xxhash64(col(right_key)))
    is_hot = F.col(HOT_HASH).isin(hashes)

    def half(df: DataFrame, hot: bool) -> DataFrame:
        return df.where(is_hot if hot else ~is_hot)

    cold = _null_safe_join(half(left, False).drop(HOT_HASH), half(right, False).drop(HOT_HASH), left_key, right_key, how)
    hot_l, hot_r = half(left, True), half(right, True)
    parts_l, parts_r = _parts_of(hot_left, hashes, hot_rows), _parts_of(hot_right, hashes, hot_rows)
    # Spark's size of a side does not count the copies, so a side that only seems small would be broadcast with all of them
    dealt_l = _dealt(hot_l, parts_l, parts_r, SALT_LEFT, SALT_RIGHT).drop(HOT_HASH).hint("merge")
    dealt_r = _dealt(hot_r, parts_r, parts_l, SALT_RIGHT, SALT_LEFT).drop(HOT_HASH)
    same = dealt_l[_q(left_key)].eqNullSafe(dealt_r[_q(right_key)])
    same = same & (dealt_l[SALT_LEFT] == dealt_r[SALT_LEFT]) & (dealt_l[SALT_RIGHT] == dealt_r[SALT_RIGHT])
    joined = dealt_l.join(dealt_r, same, "inner").drop(SALT_LEFT, SALT_RIGHT)
    # a hot key that the other side lacks: its rows are kept as they are; the list of hot keys is short
    if how in ("left", "outer"):
        joined = joined.unionByName(_alone(hot_l, left_key, hot_r, right_key), allowMissingColumns=True)
    if how in ("right", "outer"):
        joined = joined.unionByName(_alone(hot_r, right_key, hot_l, left_key), allowMissingColumns=True)
    return cold.unionByName(joined.select(*[col(c) for c in cold.columns]))


def _alone(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    keys = other.select(col(other_key).alias("__other_key")).distinct()
    return df.join(F.broadcast(keys), df[_q(key)].eqNullSafe(keys["__other_key"]), "left_anti").drop(HOT_HASH)


def _null_safe_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    def same(a: DataFrame, b: DataFrame) -> Column:
        return a[_q(left_key)].eqNullSafe(b[_q(right_key)])

    if how != "outer":
        return left.join(right, same(left, right), how)
    # Spark splits skewed keys of left joins but not of full outer joins, so the
    # full join is the left join plus the right rows whose key is not on the
    # left; the key list of the left is made distinct before it is shuffled.
    matched = left.join(right, same(left, right), "left")
    keys = left.select(col(left_key).alias("__left_key")).distinct()
    alone = right.join(keys, right[_q(right_key)].eqNullSafe(keys["__left_key"]), "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_chain(tables: Mapping[str, DataFrame], primary_table: str, joins: Sequence[JoinSpec]) -> DataFrame:
    """Join each secondary table in turn to the primary table."""
    return reduce(lambda left, spec: join_tables(left, tables[spec.secondary_table], spec), joins, tables[primary_table])


def join_preview(
    tables: Mapping[str, DataFrame],
    primary_table: str,
    joins: Sequence[JoinSpec],
    order_by: Sequence[str] = (),
    sample_rows: int = 100,
    show_rows: int = 10,
) -> DataFrame:
    """The first rows of the chain over the first rows of the primary table."""
    order = [col(c) for c in order_by]
    primary = tables[primary_table]
    head = (primary.orderBy(*order) if order else primary).limit(sample_rows)
    joined = join_chain({**tables, primary_table: head}, primary_table, joins)
    return (joined.orderBy(*order) if order else joined).limit(show_rows)


def join_summary(spark: SparkSession, primary_table: str, joins: Sequence[JoinSpec]) -> DataFrame:
    """The chain as a table."""
    rows = [
        (i, primary_table, s.join_type, s.secondary_table, s.primary_key, s.secondary_key,
         f"{s.join_type} join with {s.secondary_table} on {s.primary_key}={s.secondary_key}")
        for i, s in enumerate(joins, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "step int, primary_table string, join_type string, secondary_table string, "
        "primary_key string, secondary_key string, description string",
    )
