"""A bundle of arrays and vocabularies, loaded as tables; and settings from strings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .npy import NpySource
from .readers import latest_version, listed, vocabulary_json


@dataclass
class Bundle:
    meta: dict
    vocabulary: DataFrame
    arrays: dict[str, DataFrame]


def load_bundle(spark: SparkSession, path: str, required: Sequence[str] = ()) -> Bundle:
    """The latest version under path: meta.json, vocab.json and the required arrays must be there; each .npy file is a table of pos and value."""
    root = latest_version(spark, path)
    names = listed(spark, root)
    missing = [n for n in ("meta.json", "vocab.json", *(f"{r}.npy" for r in required)) if n not in names]
    if missing:
        raise FileNotFoundError(f"{', '.join(missing)} missing in {root}")
    meta = json.loads(spark.read.text(f"{root}/meta.json", wholetext=True).first()[0])
    spark.dataSource.register(NpySource)
    arrays = {n.removesuffix(".npy"): spark.read.format("npy").option("path", f"{root}/{n}").load() for n in names if n.endswith(".npy")}
    return Bundle(meta, vocabulary_json(spark, f"{root}/vocab.json"), arrays)


def ranges_of(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_global, tok_start, tok_end from two arrays that are indexed by document (from 1)."""
    return starts.toDF("doc_global", "tok_start").join(ends.toDF("doc_global", "tok_end"), "doc_global").where("doc_global > 0")


def setting(values: Mapping[str, str], name: str, default):
    """A value of the default's type; the default where it is missing or can't be read. Lists are comma-separated."""
    raw = values.get(name)
    if raw is None or not raw.strip():
        return default
    if isinstance(default, bool):
        return raw.strip().lower() in ("1", "true", "yes", "y", "on")
    if isinstance(default, list):
        return [x.strip() for x in raw.split(",") if x.strip()]
    try:
        return type(default)(raw) if default is not None else float(raw)
    except ValueError:
        return default
