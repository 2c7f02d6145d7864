"""Session construction with the settings every job here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key (one order holding a third of the lines) even when
    # the split costs an extra shuffle before the per-order aggregation
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "orderlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE and skew-join handling.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the cluster's
    own settings win and AQE coalesces small shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(key, conf[key])
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    ensure_checkpoint_dir(spark)
    return spark


#: bytecode of one method beyond which HotSpot leaves it interpreted (``DontCompileHugeMethods``)
JIT_METHOD_BYTES = 8000


def keep_methods_compiled(spark: SparkSession) -> None:
    """Let Spark split a projection over small methods where whole-stage code would make one that
    the JVM never compiles; results are the same. A limit that the session has set itself stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) == 65535:
        spark.conf.set(key, str(JIT_METHOD_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where that is unset (tests) it is a folder in the warehouse, which executors share too.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
