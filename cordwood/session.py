"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Run-time settings: timestamps are read and written as UTC, and a repeated
# JSON key keeps its last value instead of failing the whole document.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def require_settings(spark: SparkSession) -> None:
    """Raise where a repeated JSON key would fail its document.

    The time zone needs no check: nothing here depends on it.
    """
    name = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(name, "false").lower() != RUNTIME_CONF[name]:
        raise ValueError(f"{name} must be true: call cordwood.session.configure(spark)")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that ``spark.checkpoint.dir`` names: fixed from here on,
    also where executors are lost. A session on one machine may do without the setting."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='cordwood-')}")
    return df.checkpoint()


def local_session(cpus: int | str = 8, app: str = "cordwood", **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
