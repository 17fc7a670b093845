"""From hits to prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docflow.functions.text import word_count


def _joined(order: str, text: str, separator: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(ordered, lambda r: r[text]), separator)


def compact_context(hits: DataFrame, max_words: int = 1000, by: str = "query_id") -> DataFrame:
    """Texts of the best hits joined in rank order while their words fit `max_words`.

    A question has k hits, so the groups are as small as k.
    """
    running = F.sum(word_count(F.col("text"))).over(
        W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return (hits.withColumn("_words", running).filter(F.col("_words") <= max_words)
            .groupBy(by).agg(F.count("*").alias("n_hits"), F.max("_words").alias("n_words"),
                             _joined("rank", "text", "\n\n").alias("context")))


def build_prompts(questions: DataFrame, history: DataFrame, context: DataFrame, system: str,
                  by: str = "session_id") -> DataFrame:
    """One prompt per question: system text, trimmed history, context, question.

    `history` must already be cut to a token budget (`memory_window`), which bounds its groups.
    """
    lines = history.groupBy(by).agg(_joined("turn", "line", "\n").alias("history"))
    prompt = F.concat_ws(
        "\n\n", F.lit(system),
        F.concat(F.lit("History:\n"), F.coalesce("history", F.lit(""))),
        F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit(""))),
        F.concat(F.lit("Question: "), "question"))
    return (questions.join(lines, by, "left").join(context.select(by, "context"), by, "left")
            .select(by, prompt.alias("prompt")))
