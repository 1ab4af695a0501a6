"""Session factory with the settings that every query relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results, not only speed.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # base64() must not wrap lines: identities are single-line text
    "spark.sql.chunkBase64String.enabled": "false",
}


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "brindle") -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in SEMANTIC_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the semantic settings on a session that the caller brought."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
