"""Named loaders (sources of examples) and named scorers, as plain functions on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Plugin = Callable[..., DataFrame]


class Registry:
    """Functions by name; a name can be taken once."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._functions: dict[str, Plugin] = {}

    def register(self, name: str) -> Callable[[Plugin], Plugin]:
        def add(fn: Plugin) -> Plugin:
            if name in self._functions:
                raise ValueError(f"{self.kind} '{name}' already registered")
            self._functions[name] = fn
            return fn

        return add

    def get(self, name: str) -> Plugin:
        if name not in self._functions:
            raise KeyError(f"no {self.kind} named '{name}'; available: {self.names()}")
        return self._functions[name]

    def names(self) -> list[str]:
        return sorted(self._functions)


LOADERS = Registry("loader")
SCORERS = Registry("scorer")
