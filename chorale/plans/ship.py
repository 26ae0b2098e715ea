"""Makes the package importable where Python code runs on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends the package's sources to the executors of this session, once.

    Nothing is sent where PYTHONPATH names the folder it lies in, as that is where workers look too. The
    archive is made in a folder of the driver and handed out by Spark; executors never read that folder.
    """
    package = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _DONE or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _DONE.add(app)
    folder = Path(tempfile.mkdtemp(prefix="chorale-sources-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "chorale-sources.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(str(folder / "chorale-sources.zip"))
