"""Row-level cleaning of news and articles. None of these shuffles but dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text as tx
from tidemark.functions.columns import zero


def drop_non_ascii(df: DataFrame, column: str) -> DataFrame:
    """Keep rows whose text is plain ASCII; missing text is dropped."""
    return df.where(tx.is_ascii(column))


def split_title_source(df: DataFrame, title: str = "title", source: str = "source") -> DataFrame:
    """Cut the source off the end of the title, unless a source column exists."""
    if source in df.columns:
        return df
    kept = [c for c in df.columns if c != title]
    return df.select(*kept, tx.before_last_part(title).alias(title), tx.last_part(title).alias(source))


def drop_repeats(df: DataFrame, content: list[str]) -> DataFrame:
    """One row per distinct content; row ids would hide the repeats.

    The distinct runs before the shuffle as well as after it, so copies of one
    row collapse on the machines that read them.
    """
    return df.select(*content).distinct()


def fold_labels(df: DataFrame, column: str, mapping: dict, out: str) -> DataFrame:
    """Codes for labels; labels outside the mapping become null."""
    expr = F.lit(None)
    for label, code in mapping.items():
        expr = F.when(F.col(column) == label, F.lit(code)).otherwise(expr)
    return df.withColumn(out, expr)


def only_organisations(df: DataFrame, column: str = "b_org") -> DataFrame:
    """News that names an organisation: flag 1, or any tag when not numeric."""
    if dict(df.dtypes)[column] in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return df.where(F.col(column) == 1)
    return df.where(F.col(column).isNotNull())


def clean_names(df: DataFrame) -> DataFrame:
    """Lower-case names with `*` as `_` and `(%)` as `_percent`."""
    return df.toDF(*[c.lower().replace("*", "_").replace("(%)", "_percent") for c in df.columns])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop the named columns; names that are absent are ignored."""
    return df.drop(*names)


def drop_missing(df: DataFrame, *names: str) -> DataFrame:
    return df.na.drop(subset=list(names))


def log_controls(df: DataFrame, *names: str) -> DataFrame:
    """Natural logs of the named columns and a constant 1; log of 0 is null."""
    logs = {n: F.ln(F.col(n).cast("double")) for n in names}
    return df.withColumns({**logs, "const": F.lit(1)})


def source_type(relevant: str = "relevant", traditional: str = "traditional"):
    """1 for a relevant source, else 2 for a traditional one, else 0."""
    return F.when(zero(relevant) > 0, 1).when(zero(traditional) > 0, 2).otherwise(0)
