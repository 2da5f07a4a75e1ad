"""Executors need this package where Python workers run; a zip of it goes with the session.

Arrow batches are also bounded in bytes, not only in rows: a batch of long
texts would otherwise be held several times over on each side.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch at most.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark context, and bound the session's Arrow batches."""
    context = spark.sparkContext
    if not 0 < int(spark.conf.get(_LIMIT).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    if getattr(context, "_tessara_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessara-")) / "tessara.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    context.addPyFile(str(target))
    context._tessara_shipped = True
