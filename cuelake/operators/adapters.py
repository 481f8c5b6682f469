"""Pluggable recognizers, proofreaders and verifiers: named callables on the rows of a task, chosen by capability."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

API_VERSION = 1


@dataclass(frozen=True)
class Adapter:
    name: str
    role: str
    capabilities: frozenset[str]
    call: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    api_version: int = API_VERSION


_ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    if adapter.api_version != API_VERSION:
        raise ValueError(f"{adapter.name}: API version {adapter.api_version}, not {API_VERSION}")
    if adapter.name in _ADAPTERS:
        raise ValueError(f"{adapter.name} is registered already")
    _ADAPTERS[adapter.name] = adapter
    return adapter


def choose(role: str, needed: set[str]) -> Adapter:
    """The first adapter by name that has the role and all needed capabilities."""
    fits = [a for _, a in sorted(_ADAPTERS.items()) if a.role == role and needed <= a.capabilities]
    if not fits:
        raise LookupError(f"no {role} adapter can do {sorted(needed)}")
    return fits[0]


def apply(adapter: Adapter, rows: DataFrame, task: str = "task_id") -> DataFrame:
    """The adapter on each task's rows; a task is one recording."""
    return rows.groupBy(task).applyInPandas(adapter.call, adapter.schema)


def dictionary_proofreader(terms: dict[str, str]) -> Adapter:
    """Proofreads by replacing known misspellings: offline and deterministic."""

    def call(units: pd.DataFrame) -> pd.DataFrame:
        text = units["text"]
        for wrong, right in terms.items():
            text = text.str.replace(wrong, right, regex=False)
        return pd.DataFrame({"task_id": units["task_id"], "idx": units["idx"], "corrected_text": text, "changed": text != units["text"]})

    return Adapter("dictionary", "calibration", frozenset({"text", "structured_output"}), call, "task_id long, idx long, corrected_text string, changed boolean")
