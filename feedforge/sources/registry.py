"""Datasets by name, settings files and lookup dumps."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """Where a dataset's raw and processed files and its vectors are."""

    kind: str
    processed: str
    raw: str | None = None
    archives: tuple[str, ...] = ()
    vectors: str | None = None


class Registry:
    """Datasets by key; a key that nobody registered raises."""

    def __init__(self) -> None:
        self.known: dict[str, Dataset] = {}

    def register(self, key: str, dataset: Dataset) -> None:
        if key in self.known:
            raise ValueError(f"dataset {key} is registered already")
        self.known[key] = dataset

    def __getitem__(self, key: str) -> Dataset:
        if key not in self.known:
            raise ValueError(f"unknown dataset: {key}")
        return self.known[key]


def from_settings(settings: dict, raw: str, processed: str) -> Registry:
    """A registry of settings {key: {kind, archives, raw, vectors}}, with folders under raw and processed."""
    out = Registry()
    for key, s in settings.items():
        vectors = s.get("vectors")
        out.register(key, Dataset(s["kind"], f"{processed}/{key}", f"{raw}/{s['raw']}" if s.get("raw") else None, tuple(s.get("archives", ())), f"{processed}/{vectors}" if vectors else None))
    return out


def read_settings(path: str) -> dict:
    """Settings from JSON, or from YAML where a parser is installed."""
    text = Path(path).read_text()
    return _yaml().safe_load(text) if Path(path).suffix in (".yaml", ".yml") else json.loads(text)


def write_settings(path: str, settings: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(_yaml().safe_dump(settings, sort_keys=True) if Path(path).suffix in (".yaml", ".yml") else json.dumps(settings, indent=2, sort_keys=True))


def _yaml():  # noqa: ANN202
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("YAML settings need a YAML parser; write JSON instead") from e
    return yaml


def flattened(nested: dict, sep: str = "-") -> dict:
    """A dictionary without dictionaries in it: inner keys before outer ones."""
    out: dict = {}
    for key, value in nested.items():
        out |= {f"{inner}{sep}{key}": v for inner, v in flattened(value, sep).items()} if isinstance(value, dict) else {key: value}
    return out


def require_key(nested: dict[str, dict], key: str) -> None:
    """Raise ValueError unless every inner dictionary has the key."""
    bad = [k for k, v in nested.items() if not isinstance(v, dict) or key not in v]
    if bad:
        raise ValueError(f"{key!r} is missing in {bad}")


def write_lookup(df: DataFrame, path: str, key: str) -> None:
    """JSON lines of key and the row's other columns as one object."""
    rest = [c for c in df.columns if c != key]
    df.select(F.col(key).cast("string").alias("key"), F.struct(*rest).alias("value")).write.mode("overwrite").json(path)


def read_lookup(spark, path: str, schema: str) -> DataFrame:  # noqa: ANN001
    """key, value of `write_lookup`; the schema is the value's."""
    return spark.read.schema(f"key string, value struct<{schema}>").json(path)
