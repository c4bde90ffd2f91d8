"""Session settings and code shipping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine's expressions rely on; performance settings stay with the cluster.
NEEDED = {"spark.sql.mapKeyDedupPolicy": "LAST_WIN"}

_shipped: set[str] = set()


def build_session(name: str = "filmweave", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in ({"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | NEEDED | settings).items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on, and the package itself for Python workers (once per application)."""
    for key, value in NEEDED.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="filmweave-code-"), "filmweave.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
    return spark
