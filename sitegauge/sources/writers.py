"""Writers, including the incremental feature table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.companies import not_done


def append_jsonl(records: DataFrame, path: str, text: str = "text_content") -> None:
    """One object per line for rows with text; earlier files stay as they are."""
    records.filter(~is_blank(F.col(text))).write.mode("append").json(path)


def _plain_csv(rows: DataFrame, mode: str):
    """Header, and white space at the ends of a field kept."""
    return (
        rows.write.mode(mode)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    _plain_csv(rows, mode).option("escape", '"').csv(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Further part files with the same header; the reader drops the header of each."""
    write_csv(rows, path, mode="append")


def write_chunks_csv(chunks: DataFrame, path: str) -> None:
    """All fields quoted, backslash escapes. UTF-8 without byte-order mark."""
    _plain_csv(chunks, "overwrite").option("quoteAll", True).option("escape", "\\").csv(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def existing(rows: DataFrame, path: str) -> DataFrame | None:
    """The table at ``path`` or None."""
    try:
        return rows.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table lacks; nothing already written is rewritten.

    To skip the work for known keys as well, filter the inputs by ``companies.not_done`` first.
    """
    done = existing(rows, path)
    fresh = rows if done is None else not_done(rows, done, key)
    fresh.write.mode("append").parquet(path)


def write_label_maps(labels: DataFrame, path: str) -> None:
    """``kind, label, id`` rows as one document ``{kind: {label: id}}``; a label domain is small."""
    one = labels.groupBy().agg(
        *[
            F.map_from_entries(
                F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("label", "id"))))
            ).alias(kind)
            for kind in ("revenue2id", "category2id")
        ]
    )
    one.coalesce(1).write.mode("overwrite").json(path)


def write_label_rows(labels: DataFrame, path: str) -> None:
    labels.select("kind", "label", "id").write.mode("overwrite").json(path)
