"""A PySpark-native analytics engine for signals on the sphere."""

from __future__ import annotations

import atexit
import hashlib
import io
import shutil
import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark):
    """Sends this package's modules to the executors of a session, once for each: Python functions name them, and executors need not have them. Whatever makes such a function calls this; returns the session."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or not Path(__file__).is_file():
        return spark
    root = Path(__file__).parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    made = Path(folder) / f"spheric-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip"
    made.write_bytes(held.getvalue())
    context.addPyFile(str(made))
    _SHIPPED.add(context.applicationId)
    return spark
