"""What the operators share: reading tables, words, the shared folder.

Every operator first selects the columns it needs, so further columns of its
input, whatever their names, cannot meet its own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words: blank, tab, line feed, vertical tab, form feed, return.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one in local tests only."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilframe-"))
        folder = context.getCheckpointDir()
    return folder


#: Numbers that a key is hashed to, for samples.
HASHED = 1 << 30


def chosen(key: str, wanted: int, there: int) -> Column:
    """Whether a row is in a sample of about four times ``wanted`` rows of ``there``, by a hash of
    its key: the rows of a task that a following limit looks at get fewer as tables grow."""
    most = HASHED if there <= 4 * wanted else int(HASHED * 4 * wanted / there) + 1
    return F.pmod(F.xxhash64(key), F.lit(HASHED)) < most


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder: no task of it runs again."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()

