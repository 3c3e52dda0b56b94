"""Makes the package importable on executors that do not see the driver's source folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import siltstone

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Adds the package to the Python path of all executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(siltstone.__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="siltstone-ship-"), "siltstone_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
