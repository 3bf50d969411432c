"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of ``spark``, once, unless they find it by themselves.

    Workers see PYTHONPATH and the folder that the driver was started in. A
    cluster where the package is installed needs nothing.
    """
    root = Path(__file__).resolve().parent.parent
    seen = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]}
    app = spark.sparkContext.applicationId
    if app in _sent or root in seen or root.name == "site-packages":
        return
    _sent.add(app)
    with tempfile.NamedTemporaryFile(prefix="driftmap-", suffix=".zip", delete=False) as file, zipfile.ZipFile(file, "w") as z:
        for path in sorted((root / "driftmap").rglob("*.py")):
            z.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(file.name)
