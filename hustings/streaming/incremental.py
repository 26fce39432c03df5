"""Maintained tables kept up to date from a stream of batches.

Each micro-batch applies one of the merge jobs to the last version of a table and
writes the next version. A version is named by its batch, so a batch repeated after a
failure writes the same version again. A version counts once Spark has marked it complete, so
there is no pointer that a crash could lose: readers take the highest complete version.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _version(root: str, batch_id: int) -> str:
    return f"{root}/seed" if batch_id < 0 else f"{root}/version-{batch_id}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions, oldest first; -1 is the seed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        number = -1 if name == "seed" else int(name.removeprefix("version-")) if name.startswith("version-") else None
        if number is not None and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(number)
    return sorted(found)


def seed(table: DataFrame, root: str) -> None:
    """Store the table as it is before the first batch."""
    table.write.mode("overwrite").parquet(_version(root, -1))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The latest complete version."""
    return spark.read.parquet(_version(root, versions(spark, root)[-1]))


def merge_stream(
    stream: DataFrame, root: str, merge: Merge, checkpoint: str, keep: int | None = None
) -> StreamingQuery:
    """Apply `merge(table, batch)` to every batch available now, then stop.

    With `keep`, that many versions stay: choose it by how long a reader may hold an older one.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, root) if v < batch_id]
        merge(spark.read.parquet(_version(root, before[-1])), batch).write.mode("overwrite").parquet(
            _version(root, batch_id)
        )
        if keep:
            for old in [*before, batch_id][: -max(keep, 2)]:  # a repeated batch still needs the one before it
                path = spark._jvm.org.apache.hadoop.fs.Path(_version(root, old))
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
