"""What the operators of this subpackage share: word rule, scratch tables, row keys, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session has none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="skewline-checkpoint-")
            sc.setCheckpointDir(path)
            path = sc.getCheckpointDir()
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    # Nothing refers to the write's plan any more: its shuffle files go with the driver's garbage.
    spark.sparkContext._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that `written` made, once all that reads them has been written itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only when the side has at most `most` rows; beyond it the planner chooses (shuffle, skew split)."""
    return F.broadcast(df) if rows <= most else df
