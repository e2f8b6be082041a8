"""Session helper and table access."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quarrylens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by keyword, dots written as underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Profile:
    """Caps of a bounded session. None: no cap, which is the default: caps guard a browser's memory and are no semantics."""

    results: int | None = None
    per_group: int | None = None
    findings: int | None = None
    rows: int | None = None
    origin: str = ""
    secrets_per_text: int = 3
    scope: dict = field(default_factory=dict)


FULL = Profile()
BOUNDED = Profile(results=200, per_group=100, findings=2000, rows=800)
