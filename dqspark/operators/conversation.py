"""Question-answer turns kept as rows: last turns, context texts, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.functions.text import cache_key, clean_space, truncate
from dqspark.operators.columns import col


def _check_turns(n: int) -> None:
    if not 1 <= n <= 10:
        raise ValueError("the number of turns is 1 to 10")


def last_turns(
    df: DataFrame, n: int = V.CONTEXT_TURNS, conversation: str = "conv_id", turn: str = "turn", out: str = "place"
) -> DataFrame:
    """The last n turns per conversation, the newest with place 1.

    The limit is applied before the shuffle, so a very long conversation sends
    n rows per task and no more.
    """
    _check_turns(n)
    newest = Window.partitionBy(col(conversation)).orderBy(col(turn).desc())
    return df.withColumn(out, F.row_number().over(newest)).where(F.col(out) <= n)


def question_answers(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Each user turn with the assistant turn that follows it: (conv, turn, q, a).

    Turn numbers are consecutive, so the answer is found by an equi-join on
    (conversation, turn) whose keys hardly repeat; a question without an answer
    keeps an empty one.
    """
    asked = df.where(col(role) == "user").select(
        col(conversation).alias("conv_id"), col(turn).alias("turn"), col(text).alias("q")
    )
    answered = df.where(col(role) == "assistant").select(
        col(conversation).alias("__conv"), (col(turn) - 1).alias("__turn"), col(text).alias("a")
    )
    same = (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn"))
    joined = asked.join(answered, same, "left").drop("__conv", "__turn")
    return joined.withColumn("a", F.coalesce("a", F.lit("")))


def context_block(pairs: DataFrame, n: int = V.CONTEXT_TURNS, answer_length: int = V.ANSWER_LENGTH) -> DataFrame:
    """One context text per conversation from its last n pairs, newest first."""
    kept = last_turns(pairs, n, "conv_id", "turn", "place").select(
        "conv_id", "place", clean_space(F.col("q")).alias("q"),
        truncate(clean_space(F.col("a")), answer_length).alias("a"),
    )
    # at most n rows per conversation arrive here
    listed = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "q", "a"))).alias("turns"))
    lines = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit("- Q"), t["place"].cast("string"), F.lit(": "), t["q"],
            F.lit("\n  A"), t["place"].cast("string"), F.lit(": "), t["a"],
        ),
    )
    text = F.concat_ws("\n", F.lit(V.CONTEXT_HEADER), F.array_join(lines, "\n"), F.lit(V.CONTEXT_FOOTER))
    return listed.select("conv_id", F.size("turns").alias("n_turns"), text.alias("context"))


def repeated_questions(df: DataFrame, text: str = "text", key: str = "turn_key") -> DataFrame:
    """Questions that meet under one cache key, with how often they were asked."""
    return df.groupBy(cache_key(col(text)).alias(key)).agg(F.count("*").alias("n_asked"))
