"""Named operators with declared inputs and parameters, as pipelines call them."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Operator:
    name: str
    inputs: tuple[str, ...]
    required: tuple[str, ...]
    optional: dict
    function: Callable

    def check(self, inputs: dict, parameters: dict) -> None:
        """Raises on missing and on unknown inputs and parameters."""
        missing = [x for x in self.inputs if x not in inputs] + [x for x in self.required if x not in parameters]
        unknown = [x for x in inputs if x not in self.inputs] + [x for x in parameters if x not in self.required and x not in self.optional]
        if missing or unknown:
            raise TypeError(f"{self.name}: missing {missing}, unknown {unknown}")

    def __call__(self, inputs: dict, parameters: dict):
        self.check(inputs, parameters)
        return self.function(**inputs, **parameters)

    def spec(self) -> dict:
        return {"name": self.name, "inputs": list(self.inputs), "required": list(self.required), "optional": dict(self.optional)}


OPERATORS: dict[str, Operator] = {}
_FRAMES = {"DataFrame", "DataFrame | None"}


def register(function: Callable, name: str | None = None) -> Callable:
    """Inputs are the arguments annotated as DataFrames without a default, the others are parameters."""
    inputs, required, optional = [], [], {}
    for p in inspect.signature(function).parameters.values():
        if str(p.annotation) in _FRAMES and p.default is p.empty:
            inputs.append(p.name)
        elif p.default is p.empty:
            required.append(p.name)
        else:
            optional[p.name] = p.default
    name = name or function.__name__
    OPERATORS[name] = Operator(name, tuple(inputs), tuple(required), optional, function)
    return function


def register_all() -> dict[str, Operator]:
    from eventloom.operators import aggregates, detection, drift, events, features, joins, merge, metrics, nested, series, spikes

    for module in (series, events, joins, aggregates, metrics, features, merge, detection, nested, spikes, drift):
        for name, f in vars(module).items():
            if inspect.isfunction(f) and f.__module__ == module.__name__ and not name.startswith("_"):
                if any(str(p.annotation) in _FRAMES for p in inspect.signature(f).parameters.values()):
                    register(f)
    return OPERATORS
