"""Records of CSV files with line breaks inside quoted cells, found in parallel.

A byte range of a file can't know whether it starts inside a cell. So every range is read as lines, and for each line
both cases are followed: whether it starts and ends inside a quoted cell if the range starts outside one, and
if it starts inside. The lines are written once with these four marks; the last line of each range says what the range
does to either case, and running over the ranges of a file (a few values each) gives the true case of
every range. A line that starts and ends outside is a record; the few others are put together within their
range, and what is left open at the end of a range with the beginnings of the next ones.

Nothing depends on how files are split, as the marks are stored with the lines. A quote opens a cell only
at its start, as CSV readers have it; inside, doubled quotes are quotes, and what follows the closing one belongs
to the cell. Lines end with ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capforge.session import materialised


def _closing(line: str, at: int) -> int:
    """The place behind the quote that closes a cell, seen from inside it; -1: the cell goes on."""
    while True:
        at = line.find('"', at) + 1
        if not at:
            return -1
        if line[at:at + 1] != '"':
            return at
        at += 1


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell."""
    at = 0
    while True:
        if inside or line[at:at + 1] == '"':
            at = _closing(line, at if inside else at + 1)
            if at < 0:
                return True
            inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of all files, with the place at which their byte range starts."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                                                F.col("_metadata.file_block_start").alias("start"))


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of any file goes on in the next line. If no line that starts outside a cell ends inside
    one, then by induction all lines start outside."""

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(ends_inside(line, False) for line in batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([True])], ["found"])
                return

    quoted = lines(spark, path).select("value").filter(F.col("value").contains('"'))
    return quoted.mapInArrow(opening, "found boolean").agg(F.count(F.lit(1))).first()[0] > 0


def _marked(spark: SparkSession, path: str) -> DataFrame:
    """Stored (file, start, seq, value, b0, e0, b1, e1): whether a line begins and ends inside a cell, if its range starts
    outside (0) or inside (1)."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, state = None, 0, [False, True]
        for batch in batches:
            file, start = (batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False) for i in (1, 2))
            cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                here = part.column(1)[0].as_py(), part.column(2)[0].as_py()
                if here != key:
                    key, seq, state = here, 0, [False, True]
                n = part.num_rows
                marks = [np.zeros(n, bool) for _ in range(4)]  # b0, e0, b1, e1
                done = 0
                for i in np.flatnonzero(pc.match_substring(part.column(0), '"').to_numpy(zero_copy_only=False)).tolist():
                    line = part.column(0)[i].as_py()
                    for case in (0, 1):
                        marks[2 * case][done:i + 1] = marks[2 * case + 1][done:i] = state[case]
                        state[case] = marks[2 * case + 1][i] = ends_inside(line, state[case])
                    done = i + 1
                for case in (0, 1):
                    marks[2 * case][done:] = marks[2 * case + 1][done:] = state[case]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(np.arange(seq, seq + n)), part.column(0), *[pa.array(m) for m in marks]],
                    ["file", "start", "seq", "value", "b0", "e0", "b1", "e1"])
                seq += n

    return materialised(lines(spark, path).mapInArrow(
        follow, "file string, start long, seq long, value string, b0 boolean, e0 boolean, b1 boolean, e1 boolean"), "csv-lines")


def _range_starts(marked: DataFrame) -> DataFrame:
    """(file, start, inside): whether each range starts inside a cell."""
    last = marked.groupBy("file", "start").agg(F.max_by(F.struct("e0", "e1"), "seq").alias("e")).select("file", "start", "e.e0", "e.e1")
    swap = (F.col("e0") & ~F.col("e1")).cast("long")
    upto = Window.partitionBy("file").orderBy("start")
    # a range either settles the case (both end alike), or keeps it, or turns it round
    turned = last.withColumn("swap", swap).withColumn("turns", F.sum("swap").over(upto))
    settled = F.when(F.col("e0") == F.col("e1"), (F.col("e0").cast("long") + F.col("turns")) % 2)
    before = F.last(settled, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    return turned.withColumn("inside", (F.coalesce(before, F.lit(0)) + F.col("turns") - F.col("swap")) % 2 == 1).select("file", "start", "inside")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of every record but each file's first (the header), without blank ones."""
    marked = _marked(spark, path)
    starts = materialised(_range_starts(marked), "csv-ranges").filter("inside").select("file", "start")
    inside = starts.withColumn("starts_inside", F.lit(True))
    known = marked.join(inside, ["file", "start"], "left").withColumn("turned", F.coalesce("starts_inside", F.lit(False))).select(
        "file", "start", "seq", "value", F.when(F.col("turned"), F.col("b1")).otherwise(F.col("b0")).alias("begins"),
        F.when(F.col("turned"), F.col("e1")).otherwise(F.col("e0")).alias("ends"))
    # null where a line is no record: what a caller asks of records must not be asked of other lines, which the optimiser
    # would do below the join if it saw the line alone
    alone, shut = ~F.col("begins") & ~F.col("ends"), (F.col("first") >= 0) & ~F.col("open")
    whole = known.select("start", "seq", F.when(alone, F.col("value")).alias("record"))
    # lines of one record share the number of its first line; -1: the record began in a range before
    in_range = Window.partitionBy("file", "start").orderBy("seq")
    first = F.coalesce(F.last(F.when(~F.col("begins"), F.col("seq")), ignorenulls=True).over(in_range), F.lit(-1))
    pieces = known.filter("begins OR ends").withColumn("first", first).groupBy("file", "start", "first").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "\n").alias("piece"),
        F.max_by("ends", "seq").alias("open"))
    closed = pieces.select("start", F.col("first").alias("seq"), F.when(shut, F.col("piece")).alias("record"))
    # at most two pieces a range: what goes on from before, and what is left open
    order = Window.partitionBy("file").orderBy("start", "first")
    owner = F.last(F.when(F.col("first") >= 0, F.struct("start", "first")), ignorenulls=True).over(order)
    across = pieces.filter("first < 0 OR open").withColumn("owner", owner).groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "first", "piece"))), lambda x: x["piece"]), "\n").alias("record"))
    every = whole.unionByName(closed).unionByName(across.select("owner.start", F.col("owner.first").alias("seq"), "record"))
    text = F.when(F.col("record").endswith("\r"), F.expr("left(record, char_length(record) - 1)")).otherwise(F.col("record"))
    header = (F.col("start") == 0) & (F.col("seq") == 0)
    return every.select(F.when(~header, text).alias("record")).filter(F.trim("record") != "")
