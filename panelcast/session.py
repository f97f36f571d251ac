"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Heap of a local session; ``PANELCAST_LOCAL_HEAP`` overrides it.
LOCAL_DRIVER_MEMORY = os.environ.get("PANELCAST_LOCAL_HEAP", "8g")

# Settings a local run needs; on a cluster the submitter's settings win
# because ``getOrCreate`` keeps an existing session as it is.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "panelcast") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Local mode runs every task in the driver JVM; its default 1 GB
            # heap makes GC dominate. Only applies when this call starts the JVM.
            builder = builder.config("spark.driver.memory", LOCAL_DRIVER_MEMORY)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    (a bare local test session) is a private folder created and set; any other
    master needs the setting, as executors do not share local folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="panelcast-ckpt-")
        os.makedirs(conf_dir, exist_ok=True)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
