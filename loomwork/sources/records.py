"""Readers of record files, judged sets and settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scoring import WEIGHTS
from .arrays import array_records


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Records of a JSON array (``.json``) or of JSON lines (``.jsonl``, ``.jsonl.gz``). With a schema an array that is not compressed is read by
    byte ranges; without one, or compressed, by one task a file."""
    lines = path.removesuffix(".gz").endswith(("l", ".ndjson"))
    if not lines and schema and not path.endswith(".gz"):
        return array_records(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_judged_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, text, gold, notes) of JSON lines with defaults. Rows without text fail when they are read."""
    rows = spark.read.schema("id string, kind string, text string, gold array<string>, gold_verified boolean, notes string").json(path)
    text = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.raise_error(F.concat(F.lit("no text in row "), F.coalesce("id", F.lit("?"))))).otherwise(F.col("text"))
    return rows.select(F.coalesce("id", F.concat(F.lit("?"), F.monotonically_increasing_id() + 1)).alias("id"), F.coalesce("kind", F.lit("abstract")).alias("kind"), text.cast("string").alias("text"), F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), F.coalesce("notes", F.lit("")).alias("notes"))


@dataclass(frozen=True)
class Settings:
    warehouse: str = "data"
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    models: dict[str, str] = field(default_factory=dict)


def read_settings(path: str) -> Settings:
    """Settings from TOML; unknown keys are ignored, missing weights have their defaults."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    own = raw.get("weights") if isinstance(raw.get("weights"), dict) else {}
    return Settings(str(raw.get("warehouse", "data")), {k: float(own.get(k, v)) for k, v in WEIGHTS.items()}, {k: str(v) for k, v in raw.get("models", {}).items()})
