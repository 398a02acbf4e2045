"""Tables that cut a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one, on a local master alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.getCheckpointDir():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plotwise-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return (named or sc.getCheckpointDir()).rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """A folder of this application inside the shared one, deleted with all tables in it when the driver's Python ends."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key not in _FOLDERS:
        _FOLDERS[key] = path = f"{shared_dir(spark)}/plotwise-{key}"
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

        def clear() -> None:
            try:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
            except Exception:  # the JVM has gone first; the folder's name says whose it was
                pass

        atexit.register(clear)
    return _FOLDERS[key]


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and kept as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: computed once, compressed, and safe when executors go.

    Files that Parquet writes keep the types and nulls of ``df``; an empty ``df`` stays empty with its schema. All tables
    of an application go when it ends, and :func:`dropped` deletes one earlier.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`written` made and that nothing will read again."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.table_path
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
