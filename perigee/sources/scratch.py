"""The folder for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: The folder made for a local session without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the warehouse where that is unset.

    Only a session in one process (local[...]), where driver and executors are the same machine, gets a temporary folder. On
    a cluster a warehouse on a local disk, as Spark's own default is, is an error: executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            folder = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="perigee-"))
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.startswith(("file:", "/")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{warehouse}/perigee-scratch"
    return folder.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A path in that folder that is not there yet."""
    return f"{shared_folder(spark)}/perigee-{uuid.uuid4().hex}"
