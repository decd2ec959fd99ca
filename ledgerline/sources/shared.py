"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder beside
    the warehouse, or a temporary one for a session within this process."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        made = tempfile.mkdtemp(prefix="ledgerline-")
    else:
        made = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    context.setCheckpointDir(made)
    return made
