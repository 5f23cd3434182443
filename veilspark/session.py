"""Makes the package importable by Python workers and sets what every operator relies on."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once per application and sets UTC and dict-like maps.

    Timestamps are naive UTC; a duplicate map key keeps its first place and last value, as
    an insertion-ordered dictionary does.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="veilspark-code-")) / "veilspark.zip"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.suffix in (".py", ".yaml"):
                    z.write(p, f"{root.name}/{p.relative_to(root)}")
        target.write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(application)
    return spark
