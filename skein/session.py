"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # headers that differ only in case
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str = "local[*]", app: str = "skein", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, once per application; an installed one does no harm beside it.

    The archive is made in the driver's own folder and passed on by Spark's file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="skein-"), "skein.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(archive)
    _sent.add(sc.applicationId)
