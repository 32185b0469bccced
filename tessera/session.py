"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings are the cluster's or the caller's."""
    builder = SparkSession.builder.appName(name)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (own | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
