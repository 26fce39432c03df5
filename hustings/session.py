"""Session defaults and the staging area for tables that several jobs read."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: str = "8", app: str = "hustings", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder.

    Where the session names none, a local run gets a folder of its own, one for each
    application; on a cluster that would be a different disk for every executor, so there
    it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.conf.get("spark.app.id", "")
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="hustings-")
        folder = _local_folders[app]
    return folder.rstrip("/")


_staged: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; `release` removes what was written there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later jobs read more than once, and read it back.

    It cuts the lineage, survives lost executors and gives Catalyst real sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Staged tables that are dropped one by one, for loops that write a table anew each round."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[DataFrame, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """What `stage` does."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        staged = self.spark.read.schema(df.schema).parquet(path)
        self.paths[staged] = path
        return staged

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table in tables:
            path = self.paths.pop(table)
            _staged.remove(path)
            _remove(self.spark, path)


SIZED = 500_000  # rows of a few numbers each, some 20 MB, that may be broadcast


def sized(df: DataFrame, name: str, limit: int = SIZED) -> DataFrame:
    """A staged table, to be broadcast if it has no more than `limit` rows, else to be joined by a shuffle."""
    staged = stage(df, name)
    return F.broadcast(staged) if staged.count() <= limit else staged


def release(spark: SparkSession) -> int:
    """Remove all staged tables; call it when no result that reads them is needed any more."""
    removed = 0
    while _staged:
        removed += _remove(spark, _staged.pop())
    return removed


def _remove(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
