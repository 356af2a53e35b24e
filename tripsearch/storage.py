"""Tables written to the shared folder, and size checks before small-side tricks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
#: Spark's setting by which the shuffle files of an action go when it ends, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may go without it (tests, the benchmark); a cluster needs a
    folder that outlives any executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tripsearch-")
    return _LOCAL_FOLDERS[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, grouped by application so it can be cleared as one."""
    return f"{shared_folder(spark)}/tripsearch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "step", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins a real size, so
    Spark broadcasts the table only when it is in fact small.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")  # the written table replaces them
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        own = f"{shared_folder(spark)}/tripsearch/{spark.sparkContext.applicationId}/".split(":", 1)[-1]
        for folder in {x.rpartition("/")[0] for x in table.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None. Reads limit+1 rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
