"""Policies that change while a stream runs, and a backlog that is let in by degrees.

Policies are rows of a table (version, body), body being the configuration file's text. Every batch reads the
newest version and swaps all policies at once; a version that can't be read as a configuration is
noted and the policies before it stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.process import mask_by_policy
from ..plans.config import Config, ConfigError, load_config
from ..plans.registry import Registry

POLICIES = "version long, body string"


class Reloaded:
    """The configuration of the newest usable version; `version` is that one's, `refused` the last that wasn't usable with its reason."""

    def __init__(self, path: str, registry: Registry | None = None):
        self.path, self.registry = path, registry or Registry()
        self.version: int | None = None
        self.config: Config | None = None
        self.refused: tuple[int, str] | None = None

    def current(self, spark: SparkSession) -> Config:
        newest = spark.read.schema(POLICIES).json(self.path).where("version is not null").agg(F.max_by(F.struct("version", "body"), "version").alias("n")).first()["n"]
        if newest is not None and newest["version"] != self.version and (self.refused is None or self.refused[0] != newest["version"]):
            try:
                config = load_config(newest["body"] or "")
                for policy in config.policies.values():
                    self.registry.enabled(policy)
            except (ConfigError, ValueError, TypeError, AttributeError) as e:
                self.refused = (newest["version"], str(e))
            else:
                self.config, self.version, self.refused = config, newest["version"], None
        if self.config is None:
            raise ConfigError(f"no usable version in {self.path}")
        return self.config


def masked_batches(requests: DataFrame, policies: Reloaded, sink: Callable[[DataFrame, int], None]):
    """A stream writer: each batch of requests (system_id, payload and others) is masked under the policies of its time and given to the sink.

    The sink gets the requests with masked_text and version. Requests of systems that no policy enables have no masked_text.
    """

    def batch(rows: DataFrame, number: int) -> None:
        config = policies.current(rows.sparkSession)
        enabled = {s: p for s, p in config.policies.items() if p.enabled}
        done = mask_by_policy(rows, enabled, policies.registry).withColumnRenamed("_masked", "masked_text").drop("_mappings")
        sink(done.withColumn("version", F.lit(policies.version).cast("long")), number)

    return requests.writeStream.foreachBatch(batch)


def lanes(spark: SparkSession, path: str, schema: str, long_chars: int, max_bytes: str = "64m", max_files: int = 100, text_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(short, long): two streams over a folder of requests, of texts up to long_chars and beyond.

    Each takes in at most max_bytes and max_files a batch (one file at least), oldest first, so a backlog is
    drained in bounded batches; as the lanes are queries of their own, short requests don't wait for long ones.
    """
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path) if max_bytes is None else spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(path)
    size = F.coalesce(F.length(text_col), F.lit(0))
    return found.where(size <= long_chars), found.where(size > long_chars)
