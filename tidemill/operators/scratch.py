"""The folder that all executors see, for tables between the steps of an operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary one in a local session, an error on a cluster without."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, _local[context.applicationId], ignore_errors=True)
    return f"file://{_local[context.applicationId]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that it is worked out once and no lineage grows with rounds."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemill-scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
