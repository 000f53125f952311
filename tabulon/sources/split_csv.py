"""CSV files with quoted line breaks, read by many tasks.

The text reader hands out lines by blocks of a file. Whether a block begins inside a quoted value
follows from the number of quotes in the blocks before it, so a first pass counts quotes per
block. Then each block puts its lines together into records; only the pieces of records that
cross a block's end are brought together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tabulon.operators.bounded import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kinds of pieces: a whole record, the end or the middle of one begun in an earlier block, the
#: beginning of one that goes on in the next.
WHOLE, LATER, BEGUN = 0, 1, 2
MOST_BLOCKS = 1_000_000


class _Records:
    """Pieces of one block, from its lines in order."""

    def __init__(self, file: str, block: int, inside: bool, header: bool):
        self.file, self.block, self.header = file, block, header and block == 0
        self.inside = inside
        self.kind = LATER if inside else WHOLE
        self.lines: list[str] = []
        self.out: list[tuple[str, int, int, str]] = []

    def add(self, line: str) -> None:
        self.lines.append(line)
        if line.count('"') % 2:
            self.inside = not self.inside
        if not self.inside:
            self._close(self.kind)
            self.kind = WHOLE

    def _close(self, kind: int) -> None:
        text = "\n".join(self.lines)
        self.lines = []
        if kind == WHOLE and self.header:
            self.header = False
        elif kind != WHOLE or text.strip("\r"):  # empty lines are no records
            self.out.append((self.file, self.block, kind, text))

    def end(self) -> None:
        if self.lines:
            self._close(LATER if self.kind == LATER else BEGUN)


def record_texts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``: the text of every record of the files, without their headers."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "block").agg(F.pmod(F.sum(quotes), F.lit(2)).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts, small = pin(parity.select(
        F.col("file").alias("__file"), F.col("block").alias("__block"),
        (F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)) == 1).alias("inside")), MOST_BLOCKS)
    if not small:  # a row per block; a join by shuffle would lose the lines' order
        raise ValueError("too many blocks; raise spark.sql.files.maxPartitionBytes")
    known = lines.join(starts, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).select("value", "file", "block", "inside")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Records | None = None
        for batch in batches:
            done: list[tuple] = []
            for value, file, block, inside in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or (now.file, now.block) != (file, block):
                    if now is not None:
                        now.end()
                        done += now.out
                    now = _Records(file, block, inside, header)
                now.add(value)
            if now is not None:
                done += now.out
                now.out = []
            yield _batch(done)
        if now is not None:
            now.end()
            yield _batch(now.out)

    pieces = known.mapInArrow(assemble, "file string, block long, kind int, record string")
    # a record that crosses blocks: its beginning, and what follows up to the next beginning
    crossing = pieces.where(F.col("kind") != WHOLE)
    begun = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = crossing.withColumn("number", F.count_if(F.col("kind") == BEGUN).over(begun))
    joined = crossing.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts")
    ).select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return pieces.where(F.col("kind") == WHOLE).select("record").unionByName(joined)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "block", "kind", "record"])


def read_split_csv(spark: SparkSession, path: str, schema: StructType | str, form: dict[str, str], header: bool = True) -> DataFrame:
    """The table in the files, each read by as many tasks as it has blocks. ``form`` has the CSV
    options; the quote is ``"``, doubled inside a value. Compressed files are one block."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    parsed = record_texts(spark, path, header).select(F.from_csv("record", ddl, {**form, "emptyValue": ""}).alias("r"))
    return parsed.select("r.*")
