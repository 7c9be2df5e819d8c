"""Intermediate tables in the folder that all executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from ``spark.checkpoint.dir``.

    Without that setting it is a folder in the session's warehouse, whatever the master.
    A path on the local disk is refused if there are executors besides the driver, unless
    the setting names it with an explicit ``file:`` scheme, as for a mounted shared disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
            if folder.startswith(("file:", "/")) and not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def files_of(spark: SparkSession, path: str):
    """Spark's file system of ``path``, and ``path`` as it names it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(table: DataFrame) -> DataFrame:
    """``table`` computed once into the shared folder and read back from there.

    Later uses start from the files, also after executors are lost.
    """
    spark = table.sparkSession
    path = new_folder(spark)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete every intermediate table of this session, once its results are written.

    Each session has its own folder below the setting, so other sessions keep theirs.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        files, path = files_of(spark, folder)
        for entry in files.listStatus(path):
            files.delete(entry.getPath(), True)
