"""Text scores and entity tags.

The default scorer is a word list evaluated inside the JVM, in the scan's own
stage. A model of the caller's runs in Arrow batches, loaded once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import col, ratio, zero
from tidemark.functions.text import words


def lexicon_score(df: DataFrame, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """label and score: which list wins, and by what share of the hits.

    Missing text scores as empty text.
    """
    found = words(F.coalesce(F.col(text), F.lit("")))
    hits = lambda names: F.size(F.filter("_w", lambda w: w.isin(list(names))))
    rows = df.withColumn("_w", found).withColumns({"_p": hits(positive), "_n": hits(negative)})
    label = F.when(F.col("_p") > F.col("_n"), "positive").when(F.col("_p") < F.col("_n"), "negative").otherwise("neutral")
    score = zero(ratio(F.abs(F.col("_p") - F.col("_n")), F.col("_p") + F.col("_n")))
    return rows.withColumns({"label": label, "score": score}).drop("_w", "_p", "_n")


Scorer = Callable[[pd.Series], tuple[pd.Series, pd.Series]]


def model_score(df: DataFrame, text: str, load: Callable[[], Scorer]) -> DataFrame:
    """label and score from a model; `load` runs once per task, not per batch.

    Scores are columns of the same row, so nothing is joined back by position.
    """

    @F.pandas_udf("label string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            label, value = score(batch.fillna(""))
            yield pd.DataFrame({"label": label, "score": value})

    out = df.withColumn("_s", scored(F.col(text)))
    return out.withColumns({"label": F.col("_s.label"), "score": F.col("_s.score")}).drop("_s")


def entity_tags(text: str | Column, gazetteer: dict[str, list[str]]) -> Column:
    """Tag -> matched words, in order of appearance; tags without a match are left out.

    Every tag keeps its own words.
    """
    tokens = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))

    def matches(names: list[str]) -> Column:
        return F.filter(tokens, lambda w: w.isin(names))

    entries = F.array(*[
        F.struct(F.lit(tag).alias("tag"), matches(list(names)).alias("words")) for tag, names in gazetteer.items()
    ])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["words"]) > 0))
