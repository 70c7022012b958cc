"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylattice.session import freed_shuffles, setting, ship_package, stage_dir  # noqa: F401

# Characters that separate words: blank, and tab to carriage return. Fixed values.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

TEXT_ROWS = 1000  # of an Arrow batch of whole texts
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, name: str = "cut", batch_rows: int | None = None, **options) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table; options are those of the writer.

    Lost executors cannot undo the work, and the shuffle files of the finished job are freed at once.
    `batch_rows` bounds the Arrow batches of Python steps in this plan, which both sides hold in memory.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}/{uuid.uuid4().hex}"
    with ExitStack() as settings:
        settings.enter_context(freed_shuffles(spark))
        if batch_rows:
            settings.enter_context(setting(spark, _BATCH, str(batch_rows)))
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = f"_{base}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, also where `body` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are among the given ones; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def total_text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one pass over the column, one number to the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """Shuffle width so that a partition gets about `each` of `size`, at least the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
