"""Operators by name, and what the planner must know of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


class Catalog(dict):
    """Operators by name. A name means one operator for good: there is no replacing."""

    def __setitem__(self, name: str, item) -> None:
        if self.setdefault(name, item) is not item:
            raise ValueError(f"the name {name} is taken")

    def __missing__(self, name: str):
        raise KeyError(f"unknown operator {name}; known are {', '.join(sorted(self))}")

    get = dict.__getitem__


TRANSFORMERS, COMPOSERS, PREDICTIONS = Catalog(), Catalog(), Catalog()


@dataclass(frozen=True)
class Contract:
    """dense: rows for all active keys are needed. trace: pass, parent_max, shift, current_and_shift_max, rolling_max, ffill, bfill, none or custom."""

    dense: bool = True
    trace: str = "none"
    deterministic: bool = True
    trace_function: Callable | None = None


@dataclass(frozen=True)
class Operator:
    """column: value Column(s) and parameters to a Column. frame: DataFrame with value, v1, v2, ... to a DataFrame with value."""

    name: str
    kind: str
    contract: Contract
    column: Callable | None = None
    frame: Callable | None = None
    panels: tuple[str, ...] = ()
    many: str | None = None
    arity: int | None = 1
    builtin: bool = True
    extra: dict = field(default_factory=dict)

    def operation(self, *frames, **params):
        """The operator on bare DataFrames (time, asset_id, value)."""
        from ..plans.graph import apply_operator

        return apply_operator(self, list(frames), params)

    def __call__(self, *inputs, name: str | None = None, metadata: dict | None = None, **params):
        from ..plans.graph import Graph, make_node

        return Graph(make_node(self, inputs, params, name, metadata))


def transformer(name: str, *, dense: bool = False, trace: str = "pass", panels: tuple[str, ...] = (), many: str | None = None, frame: bool = False):
    """Registers a built-in transformer; panels name auxiliary inputs, many names a list of them."""

    def register(f: Callable) -> Operator:
        op = Operator(name, "transformer", Contract(dense, trace), None if frame else f, f if frame else None, panels, many)
        TRANSFORMERS[name] = op
        return op

    return register


def composer(name: str, *, arity: int | None = 2, dense: bool = False, frame: bool = False):
    def register(f: Callable) -> Operator:
        op = Operator(name, "composer", Contract(dense, "parent_max"), None if frame else f, f if frame else None, arity=arity)
        COMPOSERS[name] = op
        return op

    return register


def custom_transformer(name: str, contract: Contract | None = None, *, panels: tuple[str, ...] = (), many: str | None = None):
    """Registers a user's DataFrame -> DataFrame function; it gets dense input and its output is cut to the domain.

    panels name keyword arguments that are panels, many one that is a list of them; the function gets them as DataFrames on the keys of its input."""

    def register(f: Callable) -> Operator:
        op = Operator(name, "transformer", contract or Contract(), None, f, tuple(panels), many, builtin=False)
        TRANSFORMERS[name] = op
        return op

    return register


def custom_composer(name: str, contract: Contract | None = None):
    def register(f: Callable) -> Operator:
        op = Operator(name, "composer", contract or Contract(), None, f, arity=None, builtin=False)
        COMPOSERS[name] = op
        return op

    return register
