"""Records of CSV files with line breaks inside quotes, read by many tasks.

Where a byte range starts inside quotes can't be seen from the range itself. A first pass counts
the quotes of each range; their running parity, a row per range, says which ranges start
inside. A second pass joins lines to records range by range. A record that crosses ranges leaves
a piece in each, and only these few pieces are shuffled to be put together.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

WHOLE, BEGIN, REST = range(3)
PIECES = "file string, block long, pos long, kind int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value")
    )


def _inside(lines: DataFrame, quote: str) -> set[tuple[str, int]]:
    """The ranges that start inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    ranges = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("odd", F.sum("odd").over(before) % 2).where("odd = 1")
    return {(r["file"], r["block"]) for r in starts.select("file", "block").collect()}


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(record, row_no): every record of the files but blank ones, and its place (file, block, pos).

    Quotes stand around whole fields and are doubled inside them, as in RFC 4180. A record left
    open at the end of its file is a record too. Line breaks inside quotes are kept as they are.
    """
    lines = _lines(spark, path)
    inside = _inside(lines, quote)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pos = None
        held: list[str] = []  # lines of a record that is still open
        begun = 0  # the place of its first line
        kind = WHOLE

        def left_open() -> Iterator[pa.RecordBatch]:
            if held:
                yield _batch([at], [begun], [REST if kind == REST else BEGIN], ["\n".join(held)])

        for batch in batches:
            files, blocks, values = (batch.column(i) for i in range(3))
            names, numbers = files.dictionary_encode(), blocks.to_numpy(zero_copy_only=False)
            codes = names.indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if lo == hi:
                    continue
                here = (files[lo].as_py(), int(numbers[lo]))
                if here != at:
                    yield from left_open()
                    at, pos, held, kind = here, 0, [], REST if here in inside else WHOLE
                part = values.slice(lo, hi - lo)
                open_ = bool(held) or (pos == 0 and kind == REST)
                ends = (np.cumsum(pc.count_substring(part, quote).to_numpy(zero_copy_only=False)) + open_) % 2 == 0
                texts, found = part.to_pylist(), ([], [], [])
                first = 0
                for end in np.flatnonzero(ends).tolist():
                    own = texts[first : end + 1]
                    place = begun if held else pos + first
                    found[0].append(place)
                    found[1].append(REST if kind == REST else WHOLE)
                    found[2].append("\n".join([*held, *own]) if held or len(own) > 1 else own[0])
                    held, kind, first = [], WHOLE, end + 1
                if first < len(texts):
                    begun = begun if held else pos + first
                    held = [*held, *texts[first:]]
                pos += hi - lo
                if found[0]:
                    yield _batch([at] * len(found[0]), *found)
        yield from left_open()

    pieces = lines.mapInArrow(run, PIECES)
    return _joined(pieces).where("NOT (record RLIKE '^\\\\s*$')")


def _batch(places: list, pos: list, kinds: list, records: list) -> pa.RecordBatch:
    columns = (
        pa.array([f for f, _ in places], pa.string()), pa.array([b for _, b in places], pa.int64()), pa.array(pos, pa.int64()),
        pa.array(kinds, pa.int32()), pa.array(records, pa.string()),
    )
    return pa.RecordBatch.from_arrays(list(columns), names=["file", "block", "pos", "kind", "record"])


def _joined(pieces: DataFrame) -> DataFrame:
    """Whole records, and those put together from the pieces of several ranges."""
    row_no = F.struct("file", "block", "pos").alias("row_no")
    clean = F.regexp_replace("record", "\r$", "").alias("record")
    whole = pieces.where(F.col("kind") == WHOLE).select(clean, row_no)
    # At most two pieces a range: the rest of an earlier record, and the begin of one.
    order = Window.partitionBy("file").orderBy("block", "pos")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("n", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
    lines = F.array_sort(F.collect_list(F.struct("block", "pos", "record")))
    put = parts.groupBy("file", "n").agg(lines.alias("lines")).select(
        F.array_join("lines.record", "\n").alias("record"), "file", F.col("lines")[0]["block"].alias("block"), F.col("lines")[0]["pos"].alias("pos")
    )
    return whole.unionByName(put.select(clean, row_no))
