"""Session helpers: a tuned local session for tests/bench and checkpoint-dir discovery."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tessera", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session names none *and* runs in local mode (tests, bench) do we
    create a private scratch folder; on a cluster an unset dir is an error, because a
    machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per session), so that they can import
    it wherever the driver was started. Spark's own file server distributes the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    d = tempfile.mkdtemp(prefix="tessera-code-")  # served by the driver until it ends
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(d, "tessera"), "zip", os.path.dirname(top), os.path.basename(top)))
    sc._tessera_shipped = True


def default_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover - conf always present in practice
        return 8
