"""Exact quantiles and modes that do not need all values in one task.

``percentile`` and ``mode`` keep a map of all distinct values in one aggregation
buffer.  That is fine for columns with few distinct values; the others are
answered by mergeable sketches of bounded size and exact counts that certify
what the sketches say.  What reaches the driver is numbers and sketches, never
values in proportion to a column.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators.columns import family, known, one_row

#: Distinct values up to which a column's values are counted in a map.
DISTINCT_LIMIT = 10_000
GRID_ACCURACY = 10_000
#: Size of a quantile sketch, which holds up to so many values exactly, and how far its ranks may be off beyond.
SKETCH, SKETCH_ERROR = 4096, 0.002
#: Frequent values looked at per column, counters kept for them, and the share of the rows per counter that a count may miss.
CANDIDATES, TRACKED, MISSED = 8, 8192, 3.5


def distinct_estimates(df: DataFrame, names: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Non-missing and estimated distinct count per column, in one aggregate."""
    names = list(dict.fromkeys(names))
    wanted = {}
    for i, name in enumerate(names):
        wanted[f"n_{i}"] = F.count(known(df, name))
        wanted[f"d_{i}"] = F.approx_count_distinct(known(df, name))
    got = one_row(df, wanted)
    return {name: (got[f"n_{i}"], got[f"d_{i}"]) for i, name in enumerate(names)}


def quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    approx: bool = False,
    distinct_limit: int = DISTINCT_LIMIT,
    estimates: Mapping[str, tuple[int, int]] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, per column."""
    return quantiles_and_modes(df, wanted, (), approx, distinct_limit, estimates)[0]


def modes(
    df: DataFrame,
    names: Iterable[str],
    distinct_limit: int = DISTINCT_LIMIT,
    estimates: Mapping[str, tuple[int, int]] | None = None,
) -> dict[str, object]:
    """Most frequent value per column, the lowest on ties."""
    return quantiles_and_modes(df, {}, names, False, distinct_limit, estimates)[1]


def quantiles_and_modes(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    mode_of: Iterable[str],
    approx: bool = False,
    distinct_limit: int = DISTINCT_LIMIT,
    estimates: Mapping[str, tuple[int, int]] | None = None,
) -> tuple[dict[str, list[float | None]], dict[str, object]]:
    """Quantiles and modes of several columns.

    Columns with few distinct values share one aggregate.  Of the others, the
    values at the wanted ranks are closed in from both sides (see
    :func:`_order_statistics`); modes are named by sketches of frequent values
    and counted in one more aggregate (see :func:`_frequent_modes`), by a shuffled
    ``groupBy`` only where no value stands out.  ``approx`` takes Spark's
    approximate quantiles.
    """
    mode_of = list(dict.fromkeys(mode_of))
    if not wanted and not mode_of:
        return {}, {}
    sizes = estimates
    if sizes is None:
        sizes = distinct_estimates(df, mode_of if approx else [*wanted, *mode_of])
    small = {c: list(p) for c, p in wanted.items() if approx or sizes[c][1] <= distinct_limit}
    few = [c for c in mode_of if sizes[c][1] <= distinct_limit]
    aggregates = {}
    for i, (c, p) in enumerate(small.items()):
        x = known(df, c).cast("double")
        shares = F.array(*[F.lit(float(v)) for v in p])
        aggregates[f"q_{i}"] = F.percentile_approx(x, p, GRID_ACCURACY) if approx else F.percentile(x, shares)
    for i, c in enumerate(few):
        aggregates[f"m_{i}"] = F.mode(known(df, c), True)
    large = {c: p for c, p in wanted.items() if c not in small}
    ranks = {c: sorted({r for p in ps for r in _rank_pair(sizes[c][0], p)}) for c, ps in large.items()}
    at_rank, got = _order_statistics(df, ranks, aggregates)
    result = {c: got[f"q_{i}"] or [None] * len(p) for i, (c, p) in enumerate(small.items())}
    found_modes = {c: got[f"m_{i}"] for i, c in enumerate(few)}
    for c, ps in large.items():
        row = []
        for p in ps:
            position = (sizes[c][0] - 1) * p
            low, high = (at_rank[c, r] for r in _rank_pair(sizes[c][0], p))
            row.append(low + (high - low) * (position - math.floor(position)))
        result[c] = row
    found_modes |= _frequent_modes(df, [c for c in mode_of if c not in found_modes])
    for c in mode_of:
        if c not in found_modes:
            values = df.select(known(df, c).alias("v")).where("v IS NOT NULL")
            counted = values.groupBy("v").agg(F.count("*").alias("n"))
            best = counted.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
            found_modes[c] = best.first()["v"]
    return {c: result[c] for c in wanted}, {c: found_modes[c] for c in mode_of}


def _rank_pair(n: int, p: float) -> tuple[int, int]:
    position = (n - 1) * p
    return math.floor(position), math.ceil(position)


def _order_statistics(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], also: Mapping[str, Column]
) -> tuple[dict[tuple[str, int], float], dict]:
    """Values at the given 0-based ranks, and other aggregates read along.

    Every open rank has a bracket that holds it for certain and a guess within
    it.  One aggregate per round counts the values below, at and between the two
    ends of each guess, which either finds the value, or makes the guess the
    bracket, or leaves the stretch beside it; a sketch of the values between the
    ends gives the next guess.  A guess keeps less than a hundredth of the values,
    and a sketch that has seen no more values than its size knows them all, so
    few rounds are needed; the last one confirms by counts.  Ranks that share a
    guess share its aggregates.
    """
    inf = float("inf")
    bracket = {(c, r): (-inf, inf) for c, rs in ranks.items() for r in rs}
    guess = dict(bracket)
    done: dict[tuple[str, int], float] = {}
    read_along = {}
    while guess or also:
        wanted, also = dict(also), {}
        groups: dict[tuple[str, float, float], list[int]] = {}
        for (c, r), (low, high) in sorted(guess.items()):
            groups.setdefault((c, low, high), []).append(r)
        for i, ((c, low, high), rs) in enumerate(groups.items()):
            x = known(df, c).cast("double")
            inside = F.when((x > low) & (x < high), x)
            wanted |= {
                f"below_{i}": F.count_if(x < low), f"low_{i}": F.count_if(x == low),
                f"in_{i}": F.count(inside), f"high_{i}": F.count_if(x == high),
            }
            if low < high:
                wanted[f"sketch_{i}"] = F.kll_sketch_agg_double(inside, F.lit(SKETCH))
        got = one_row(df, wanted)
        read_along = read_along or got
        ends = _next_ends(df.sparkSession, groups, got)
        guess = {}
        for i, ((c, low, high), rs) in enumerate(groups.items()):
            for j, run in enumerate(_runs(rs)):
                for r in run:
                    place = r - got[f"below_{i}"]
                    least, most = bracket[c, r]
                    if place < 0:
                        bracket[c, r] = guess[c, r] = (least, low)
                    elif place < got[f"low_{i}"]:
                        done[c, r] = low
                    elif place < got[f"low_{i}"] + got[f"in_{i}"]:
                        bracket[c, r], guess[c, r] = (low, high), ends[i, j]
                    elif low == high or place < got[f"low_{i}"] + got[f"in_{i}"] + got[f"high_{i}"]:
                        if low == high:  # all values at the one end lie below the rank
                            bracket[c, r] = guess[c, r] = (high, most)
                        else:
                            done[c, r] = high
                    else:
                        bracket[c, r] = guess[c, r] = (high, most)
    return done, read_along


def _next_ends(spark: SparkSession, groups: Mapping[tuple, list[int]], got: Mapping) -> dict[tuple[int, int], tuple]:
    """Two values per run of ranks that a sketch puts around them."""
    asked, sketches = {}, {}
    for i, rs in enumerate(groups.values()):
        n = got[f"in_{i}"]
        error = 0.0 if n <= SKETCH else SKETCH_ERROR
        for j, run in enumerate(_runs(rs)):
            first, last = (r - got[f"below_{i}"] - got[f"low_{i}"] for r in (run[0], run[-1]))
            if not n or last < 0 or first >= n:
                continue
            sketches[f"s_{i}"] = got[f"sketch_{i}"]
            for name, share in (("from", (first + 0.5) / n - error), ("to", (last + 0.5) / n + error)):
                asked[f"{name}_{i}_{j}"] = F.kll_sketch_get_quantile_double(F.col(f"s_{i}"), F.lit(min(1.0, max(0.0, share))))
    if not asked:
        return {}
    held = spark.createDataFrame([tuple(sketches.values())], ", ".join(f"{c} binary" for c in sketches))
    found = one_row(held, {c: F.first(x) for c, x in asked.items()})
    return {
        tuple(map(int, c.split("_")[1:])): (found[c], found[c.replace("from", "to")]) for c in found if c.startswith("from")
    }


def _runs(ranks: Sequence[int]) -> list[list[int]]:
    """Ranks next to each other together."""
    out: list[list[int]] = []
    for r in ranks:
        if out and r == out[-1][-1] + 1:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def _frequent_modes(df: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """Modes of the columns in which some value clearly stands out, in two aggregates for all of them.

    A sketch with m counters over n values misses or misjudges a value by at most
    3.5 n / m.  Its first values are counted exactly; if the best count exceeds
    that error and what the sketch grants the last value listed, no other value
    can reach it.
    """
    names = [c for c in names if family(df.schema[c].dataType) != "other"]
    if not names:
        return {}
    first = {}
    for i, c in enumerate(names):
        x = known(df, c)
        first[f"n_{i}"] = F.count(x)
        first[f"top_{i}"] = F.call_function("approx_top_k", x, F.lit(CANDIDATES + 1), F.lit(TRACKED))
    got = one_row(df, first)
    listed, others, counts = {}, {}, {}
    for i, c in enumerate(names):
        top = got[f"top_{i}"] or []
        listed[c] = [e["item"] for e in top if e["item"] is not None]
        last = top[-1]["count"] if len(top) > CANDIDATES else 0
        others[c] = max(last, math.ceil(MISSED * got[f"n_{i}"] / TRACKED))
        for j, item in enumerate(listed[c]):
            counts[f"c_{i}_{j}"] = F.count_if(known(df, c) == F.lit(item).cast(df.schema[c].dataType))
    exact = one_row(df, counts)
    found = {}
    for i, c in enumerate(names):
        seen = [(-exact[f"c_{i}_{j}"], item) for j, item in enumerate(listed[c])]
        if not got[f"n_{i}"]:
            found[c] = None
        elif seen and -min(seen)[0] > others[c]:
            found[c] = min(seen)[1]
    return found


def skewness(c, n):
    """Sample-adjusted skewness; 0 for a constant column, NULL below three values (A10)."""
    n = n.cast("double")
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n > 2, F.coalesce(adjusted, F.lit(0.0)))
