"""Rows in order at any size: places inside groups, and digests over them.

A group may hold a third of all rows, so no window runs over a whole group:
rows are dealt to ranges of (group, order), sorted there, and a range adds the
number of rows of its group in the ranges before.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import checkpoint_dir

#: Characters of a text by which ranges are cut; ties beyond are sorted inside a range.
CUT_CHARS = 64
#: Code points of a packed run of ids, before it is hashed.
PACK = 1 << 16


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written once to the shared folder and read again: no task of it runs again."""
    path = f"{checkpoint_dir(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _parts(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(rows: DataFrame, group: str, order: Sequence[str], keep: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``keep`` with ``_group``, ``_range`` and ``_seq``, written in order, and for every
    group and range ``_first`` (its least ``_seq``), ``_before`` (rows of the group in the ranges
    before) and ``_total`` (rows of the group). Null groups are a group; nulls come first.

    The partition that a row was read from is the last key, so that rows that are alike in all
    columns, be they a third of all, lie in several ranges.
    """
    kinds = dict(rows.dtypes)
    rough = [F.substring(c, 1, CUT_CHARS) if kinds[c] == "string" else F.col(c) for c in order]
    dealt = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(
        _parts(rows), *[F.asc_nulls_first(c) for c in (F.col(group), *rough, F.col("_from"))])
    inside = dealt.sortWithinPartitions(*[F.asc_nulls_first(c) for c in (group, *order, "_from")])
    # Numbers go up inside a partition, and the partition is in the upper bits.
    written = stored(inside.select(
        F.col(group).alias("_group"), *keep, F.monotonically_increasing_id().alias("_seq"),
    ).withColumn("_range", F.shiftright("_seq", 33).cast("int")), "ranged")
    sizes = written.groupBy("_group", "_range").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    # A group has at most as many rows here as there are ranges.
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return written, sizes.select(
        "_group", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"))


def placed(written: DataFrame, sizes: DataFrame, *more: str) -> DataFrame:
    """The rows with ``place`` (from 1) and the columns ``more`` of ``sizes``: joined by group and
    range, so that a large group is as many keys as it has ranges."""
    s = sizes.withColumnsRenamed({"_group": "_g", "_range": "_r"})
    on = written["_group"].eqNullSafe(s["_g"]) & (written["_range"] == s["_r"])
    place = (F.col("_seq") - F.col("_first") + F.col("_before") + 1).alias("place")
    keep = [c for c in written.columns if c not in ("_seq", "_range")]
    return written.join(s, on).select(*keep, place, *more)


def id_digests(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``key`` and ``digest``: the hex SHA-256 of the key's numbers, ascending, decimal, joined by commas.

    The numbers are packed to runs in ranges first, in parallel; then the runs of a key are read in
    order and hashed one after the other (a digest is serial by nature), a batch in memory at a time.
    """
    rows = rows.select(key, number)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, run, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({key: pa.array([now], pa.binary()), "first": pa.array([first], pa.int64()), "ids": [",".join(run)]})

        for batch in batches:
            for name, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now or size >= PACK:
                    if run:
                        yield out()
                    now, first, run, size = name, i, [], 0
                run.append(str(i))
                size += len(run[-1]) + 1
        if run:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            names, digests = [], []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name == now:
                    sha.update(b",")
                elif sha is not None:
                    names.append(now)
                    digests.append(sha.hexdigest())
                if name != now:
                    now, sha = name, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pydict({key: pa.array(names, pa.binary()), "digest": pa.array(digests, pa.string())})
        if sha is not None:
            yield pa.RecordBatch.from_pydict({key: pa.array([now], pa.binary()), "digest": [sha.hexdigest()]})

    n = _parts(rows)
    runs = rows.repartitionByRange(n, key, number).sortWithinPartitions(key, number).mapInArrow(pack, f"{key} binary, first long, ids string")
    return runs.repartition(n, key).sortWithinPartitions(key, "first").mapInArrow(digest, f"{key} binary, digest string")
