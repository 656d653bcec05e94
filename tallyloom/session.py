"""Session settings and the shared scratch folder.

Nothing here starts work: callers bring their own ``SparkSession``; the
helpers set what results depend on (UTC time zone) and say where a plan
may be cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python: short rows are bounded by number, whole texts by size.
ARROW_ROWS = 4096
ARROW_BYTES = 1 << 20


def build_session(app_name: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of whole texts must fit beside the others of its executor.

    Plans read the settings when they run, so they are the same for every operator.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its input is so small that Spark would read it in fewer tasks than there are cores.

    For costly work on each row. What is dealt out is bounded by the bytes
    that so many read tasks hold; a larger input is left as it is read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").rstrip("b")))
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < split * cores
    return df.repartition(cores) if small else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Local masters may leave it unset and get a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tallyloom.sharedDir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.tallyloom.sharedDir", found)
    return found.rstrip("/")


#: Scratch folders that are still there, in the order in which they were made.
_folders: list[str] = []


@contextmanager
def scratch_released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch folders made within it. For callers who have stored their results by then."""
    before = len(_folders)
    try:
        yield
    finally:
        for folder in _folders[before:]:
            _delete(spark, folder)
        del _folders[before:]


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive lost executors.

    Each instance owns one fresh folder. ``drop`` deletes what no later plan
    reads; ``scratch_released`` deletes all once results are stored.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tallyloom/{label}-{uuid.uuid4().hex}"
        self._made = 0
        _folders.append(self.path)

    def new_path(self, name: str) -> str:
        self._made += 1
        return f"{self.path}/{self._made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the table that reads it back."""
        path = self.new_path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for folder in {name.rpartition("/")[0] for table in tables for name in table.inputFiles()}:
            _delete(self.spark, folder)
