"""Session settings the operators rely on."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; sizing (executors, memory, shuffle partitions) stays
# with whoever starts the session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot runs: split a skewed join partition even when the aggregation above
    # it then needs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Whole files travel to the alignment kernel; bound a batch by its size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below the checkpoint folder the session names, else, as in tests, a local one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/reviewlake-{uuid.uuid4().hex}" if named else f"file://{tempfile.mkdtemp(prefix='reviewlake-')}/x"


def settle(df: DataFrame, folder: str) -> DataFrame:
    """Cut the lineage by writing the rows once to a folder every executor can read."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
