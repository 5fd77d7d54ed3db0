"""Session settings, and the package's way to the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, adaptive execution with skew joins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=settings | conf).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application, unless PYTHONPATH already holds it."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="tidewell-")) / "tidewell.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "tidewell").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
        if (ROOT / "corpus_pipeline.py").exists():
            z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
