"""What the Python workers of these operators need."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import ship_package

#: Arrow batches of texts are held several times over (JVM, socket, worker), so they are kept small.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Ships the package and bounds the session's Arrow batches (a smaller setting of the caller's stays)."""
    ship_package(spark)
    try:
        now = int(spark.conf.get(_BATCH).rstrip("b"))
    except ValueError:  # written with a unit: the caller's own choice
        return
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
