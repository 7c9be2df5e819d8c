from types import SimpleNamespace

import pytest
from conftest import rows_of

from tallytide.shared import drop_intermediate, shared_folder, written


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, folder=None, **conf):
    settings = {name.replace("_", "."): value for name, value in conf.items()}
    return SimpleNamespace(sparkContext=Context(master, folder), conf=settings)


def test_folder_of_the_session_comes_first():
    assert shared_folder(session("yarn", "hdfs:/shared/1")) == "hdfs:/shared/1"
    assert shared_folder(session("yarn", spark_checkpoint_dir="s3a://b/c")) == "s3a://b/c"
    assert shared_folder(session("local[2]", spark_checkpoint_dir="/given")) == "/given"


def test_without_a_setting_the_warehouse_is_used():
    assert shared_folder(session("yarn", spark_sql_warehouse_dir="hdfs:/w/")) == "hdfs:/w/_intermediate"
    assert shared_folder(session("local[2]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_intermediate"
    for local in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session("spark://head:7077", spark_sql_warehouse_dir=local))


def test_written_tables_keep_rows_and_schema(spark):
    table = spark.createDataFrame([("a", 1), (None, 2)], "maker string, n bigint")
    again = written(table)
    assert again.dtypes == table.dtypes
    assert sorted(rows_of(again, "n", "maker")) == [(1, "a"), (2, None)]
    assert all(shared_folder(spark).split(":")[-1] in path for path in again.inputFiles())
    assert written(table.where("false")).count() == 0


def test_intermediate_tables_can_be_dropped(spark):
    table = written(spark.range(3))
    assert table.count() == 3
    drop_intermediate(spark)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|not found|FILE_NOT_EXIST"):
        spark.read.parquet(*table.inputFiles()).count()
    assert written(spark.range(2)).count() == 2
