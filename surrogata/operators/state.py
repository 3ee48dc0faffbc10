"""Fitted state as Parquet tables: a row a part of an array, so that no row grows with the model."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 1 << 16             # numbers of a row
SCHEMA = "name string, kind string, shape array<long>, part int, vals array<double>, text string"


def state_table(spark: SparkSession, state) -> DataFrame:
    """(name, kind, shape, part, vals, text) of the fields of a dataclass."""
    if not is_dataclass(state):
        raise TypeError("a fitted state is a dataclass")
    rows = []
    for f in fields(state):
        v = getattr(state, f.name)
        if isinstance(v, np.ndarray):
            flat = np.asarray(v, float).ravel()
            rows += [(f.name, "array", list(v.shape), k, flat[s:s + PART].tolist(), None)
                     for k, s in enumerate(range(0, max(1, flat.size), PART))]
        elif v is None:
            rows.append((f.name, "none", None, 0, None, None))
        elif isinstance(v, (bool, np.bool_)):
            rows.append((f.name, "bool", None, 0, [float(v)], None))
        elif isinstance(v, (int, np.integer)):
            rows.append((f.name, "int", None, 0, None, str(int(v))))
        elif isinstance(v, (float, np.floating)):
            rows.append((f.name, "float", None, 0, [float(v)], None))
        elif isinstance(v, str):
            rows.append((f.name, "text", None, 0, None, v))
        elif isinstance(v, list) and not v or f.name == "search":
            rows.append((f.name, "list", None, 0, None, None))         # the log of a search isn't kept
        else:
            raise TypeError(f"field {f.name}: {type(v).__name__} can't be stored")
    return spark.createDataFrame(rows, SCHEMA)


def load_state(spark: SparkSession, path: str, kind: type):
    """The dataclass that was stored at a path."""
    parts: dict[str, list] = {}
    for r in spark.read.schema(SCHEMA).parquet(path).orderBy("name", "part").collect():       # a model's size
        parts.setdefault(r["name"], []).append(r)
    if not parts:
        raise ValueError(f"no fitted state at {path}")

    def value(rows):
        first = rows[0]
        match first["kind"]:
            case "array":
                return np.concatenate([np.array(r["vals"], float) for r in rows]).reshape(first["shape"])
            case "int":
                return int(first["text"])
            case "float":
                return first["vals"][0]
            case "bool":
                return bool(first["vals"][0])
            case "text":
                return first["text"]
            case "list":
                return []
        return None

    return kind(**{name: value(rows) for name, rows in parts.items()})


def save_state(spark: SparkSession, state, path: str) -> None:
    state_table(spark, state).coalesce(1).withColumn("part", F.col("part").cast("int")).write.parquet(path)
