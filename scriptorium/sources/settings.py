"""Settings from a YAML file, with secrets by name from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

ENV = "_env"


def resolved(settings: dict, environment: Mapping[str, str] | None = None) -> dict:
    """The settings with, in each section, for each key `x_env` a key `x`: the value of the variable that it names, or ""."""
    found = os.environ if environment is None else environment
    out = {}
    for section, values in settings.items():
        if isinstance(values, dict):
            named = {key.removesuffix(ENV): found.get(name, "") for key, name in values.items() if key.endswith(ENV) and isinstance(name, str)}
            values = {**values, **named}
        out[section] = values
    return out


def load(spark: SparkSession, path: str, environment: Mapping[str, str] | None = None) -> dict:
    """The resolved settings of a YAML (or JSON) file in any store that Spark reads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    try:
        import yaml
    except ImportError:
        import json

        return resolved(json.loads(text), environment)
    return resolved(yaml.safe_load(text) or {}, environment)
