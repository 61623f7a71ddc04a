"""Operator graphs: building, checking, JSON, and lowering to one DataFrame plan.

A lowered value is a root DataFrame and a chain of named column steps on it. Values with the same root are
combined by joining their chains, so panels derived from one source need no join, equal steps are
computed once, and steps over the same axis share an exchange and a sort.
"""

from __future__ import annotations

import hashlib
import inspect
import itertools
import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import asset_order, number, trailing
from ..operators.registry import COMPOSERS, PREDICTIONS, TRANSFORMERS, Operator
from ..sources.panel import KEYS, Domain, Panel, PanelError, PredictionPanel

_names = itertools.count(1)


class GraphValidationError(ValueError):
    """The graph cannot be computed."""


@dataclass(frozen=True)
class Plan:
    root: DataFrame
    root_id: str
    steps: dict[str, Column]
    value: str
    traces: dict[str, str]
    domain: Domain
    dense: bool = False
    prediction: bool = False

    def wide(self) -> DataFrame:
        return reduce(lambda d, s: d.withColumn(*s), self.steps.items(), self.root)

    def frame(self) -> DataFrame:
        return self.wide().select(*KEYS, F.col(self.value).alias("value"), *[F.col(c).alias(t) for t, c in self.traces.items()])

    def step(self, name: str, column: Column, traces: dict[str, Column] | None = None, **more) -> Plan:
        steps = self.steps | {name: column}
        kept = dict(self.traces)
        for t, c in (traces or {}).items():
            kept[t] = f"{name}_{t}"
            steps[kept[t]] = c
        return replace(self, steps=steps, value=name, traces=kept, **more)


def _identity(*parts) -> str:
    return "x" + hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def rooted(frame: DataFrame, identity: str, domain: Domain, traces, dense: bool = False, prediction: bool = False) -> Plan:
    value = f"v_{identity}"
    names = {t: f"{value}_{t}" for t in traces}
    root = frame.select(*KEYS, F.col("value").alias(value), *[F.col(t).alias(c) for t, c in names.items()])
    return Plan(root, identity, {}, value, names, domain, dense, prediction)


def densified(plan: Plan) -> Plan:
    """Rows for all active keys; nothing to do if they are there."""
    if plan.dense:
        return plan
    wide = plan.domain.align(plan.wide())
    return replace(plan, root=wide, root_id=_identity("dense", plan.root_id, sorted(plan.steps)), steps={}, dense=True)


def merged(plans: list[Plan]) -> tuple[Plan, list[str]]:
    """One plan that holds the values of all, inner-aligned on the keys, and their column names."""
    first = plans[0]
    values = [p.value for p in plans]
    traces: dict[str, list[str]] = {}
    for p in plans:
        for t, c in p.traces.items():
            traces.setdefault(t, []).append(c)
    if all(p.root_id == first.root_id for p in plans):
        steps = reduce(lambda a, p: a | p.steps, plans, {})
        out = replace(first, steps=steps)
    else:
        roots: dict[str, Plan] = {}
        for p in plans:
            had = roots.get(p.root_id)
            roots[p.root_id] = replace(p, steps=had.steps | p.steps) if had else p
        frames = [p.wide() for p in roots.values()]
        while len(frames) > 1:  # a balanced tree of joins on the same keys
            frames = [a if b is None else _joined(a, b) for a, b in itertools.zip_longest(frames[::2], frames[1::2])]
        dense = all(p.dense for p in plans)
        out = Plan(frames[0], _identity("join", sorted((p.root_id, sorted(p.steps)) for p in roots.values())), {}, first.value, {}, first.domain, dense, first.prediction)
    # PARENT_MAX: greatest() skips nulls.
    extra = {t: (F.greatest(*[F.col(c) for c in dict.fromkeys(cs)]) if len(set(cs)) > 1 else F.col(cs[0])) for t, cs in traces.items()}
    named = {t: f"{_identity('trace', t, cs)}" for t, cs in traces.items()}
    return replace(out, steps=out.steps | {named[t]: c for t, c in extra.items()}, traces=named), values


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    same = [c for c in b.columns if c in a.columns and c not in KEYS]
    return a.join(b.drop(*same), list(KEYS), "inner")


def _trace_columns(op: Operator, plan: Plan, params: dict) -> dict[str, Column]:
    rule, out = op.contract.trace, {}
    for t, c in plan.traces.items():
        col, n = F.col(c), params.get("periods", params.get("interval", 1))
        if rule == "current_and_shift_max":
            out[t] = F.greatest(col, F.lag(col, n).over(asset_order()))
        elif rule == "shift":
            out[t] = F.lag(col, n).over(asset_order())
        elif rule == "rolling_max" and "window" in params:
            out[t] = F.max(col).over(trailing(params["window"]))
        elif rule in ("ffill", "bfill"):
            limit = params.get("limit")
            if rule == "ffill":
                out[t] = F.last(col, True).over(asset_order().rowsBetween(W.unboundedPreceding if limit is None else -limit, 0))
            else:
                out[t] = F.first(col, True).over(asset_order().rowsBetween(0, W.unboundedFollowing if limit is None else limit))
    return out


def lower_operator(op: Operator, plans: list[Plan], params: dict, literals: dict[int, float]) -> Plan:
    """literals: operands that are constants and need no join, by position."""
    first = plans[0]
    name = _identity(op.name, params, [p.value for p in plans], [p.root_id for p in plans], sorted(literals.items()))
    if op.name == "lag":
        return _calendar_lag(first, params.get("periods", 1), name)
    plan, values = merged(plans)
    if op.contract.dense or not op.builtin:
        plan = densified(plan)
    if plan.traces and op.contract.trace == "none":
        raise PanelError(f"{op.name} has no rule for traces")
    if op.column is not None:
        columns = [F.col(v) for v in values]
        for at, x in sorted(literals.items()):
            columns.insert(at, number(x))
        return plan.step(name, op.column(*columns, **params), _trace_columns(op, plan, params))
    wide = plan.wide()
    own = wide.select(*KEYS, F.col(values[0]).alias("value"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values[1:], 1)], *[F.col(c).alias(t) for t, c in plan.traces.items()])
    if op.builtin:
        done = op.frame(own, **params)
    else:
        frames = [wide.select(*KEYS, F.col(v).alias("value")) for v in values]
        given = {}
        if op.kind == "transformer":
            rest = frames[1:]
            given = dict(zip(op.panels, rest)) | ({op.many: rest[len(op.panels) :]} if op.many else {})
            frames = frames[:1]
        done = plan.domain.restrict(op.frame(*frames, **given, **params))
        if plan.traces and op.contract.trace_function is not None:
            done = op.contract.trace_function(done, own)
        elif plan.traces:
            done = done.join(own.select(*KEYS, *plan.traces), list(KEYS), "left")
    return rooted(done, name, plan.domain, plan.traces, plan.dense and op.builtin, plan.prediction)


def _calendar_lag(plan: Plan, periods: int, name: str) -> Plan:
    """A row moves to the session `periods` later; the calendar map is small and broadcast."""
    if periods == 0:
        return plan
    frame = plan.frame().join(F.broadcast(plan.domain.shifted(periods)), "time").drop("time").withColumnRenamed("to", "time")
    if plan.domain.is_dynamic:
        frame = plan.domain.restrict(frame)
    return rooted(frame, name, plan.domain, plan.traces, False, plan.prediction)


def apply_operator(op: Operator, frames: list[DataFrame], params: dict) -> DataFrame:
    """An operator on bare frames: their keys are the domain, and rows are taken as they are."""
    domain = Domain.of(frames[0])
    plans = [replace(rooted(f, f"f{i}", domain, ()), dense=True) for i, f in enumerate(frames)]
    if op.name == "lag":
        return frames[0].withColumn("value", op.column(F.col("value"), **params))
    return lower_operator(op, plans, params, {}).frame()


class Node:
    """panel, transformer, composer or prediction_composer."""

    def __init__(self, kind: str, parents: tuple, payload, params: dict, name: str | None, metadata: dict | None):
        self.kind, self.parents, self.payload, self.params = kind, parents, payload, params
        self.name = name or f"{kind}_{next(_names)}"
        self.metadata = dict(metadata or {})


def as_node(x) -> Node:
    if isinstance(x, Graph):
        if len(x.outputs) != 1:
            raise GraphValidationError("an input needs a graph with one output")
        return x.outputs[0]
    if isinstance(x, Panel):
        node = x.__dict__.get("_node")
        if node is None:
            node = x._node = Node("panel", (), x, {}, None, None)
        return node
    raise TypeError(f"an input must be a Panel or a Graph, not {type(x).__name__}")


def make_node(op: Operator, inputs: tuple, params: dict, name: str | None, metadata: dict | None) -> Node:
    params = dict(params)
    if op.kind == "composer":
        if len(inputs) < 2 or op.arity not in (None, len(inputs)):
            raise GraphValidationError(f"{op.name} takes {op.arity or 'two or more'} inputs, not {len(inputs)}")
        parents = tuple(as_node(x) for x in inputs)
    else:
        if len(inputs) != 1:
            raise GraphValidationError(f"{op.name} takes one input")
        if missing := [p for p in (*op.panels, *([op.many] if op.many else [])) if p not in params]:
            raise GraphValidationError(f"{op.name} needs the panels {missing}")
        extra = [params.pop(p) for p in op.panels]
        if op.many:
            extra += list(params.pop(op.many))
        parents = tuple(as_node(x) for x in (*inputs, *extra))
    if op.builtin:
        f = op.column or op.frame
        given = [None] * (len(parents) if op.column else 1)
        try:
            inspect.signature(f).bind(*given, **params)
        except TypeError as e:
            raise GraphValidationError(f"{op.name}: {e}") from None
    return Node(op.kind, parents, op, params, name, metadata)


class Graph:
    def __init__(self, *outputs):
        self.outputs = tuple(x if isinstance(x, Node) else as_node(x) for x in outputs)
        self.nodes = self._sorted()
        names = [n.name for n in self.nodes]
        if len(set(names)) != len(names):
            raise GraphValidationError(f"names occur twice: {sorted({n for n in names if names.count(n) > 1})}")
        for n in self.nodes:
            strict = n.parents if n.kind in ("composer", "prediction_composer") else n.parents[1:]
            if any(_predicts(p) for p in strict):
                raise GraphValidationError(f"{n.name}: predictions may only be the first input of transformers")

    def _sorted(self) -> tuple[Node, ...]:
        out: dict[int, Node] = {}
        stack = [(n, False) for n in reversed(self.outputs)]
        while stack:
            node, ready = stack.pop()
            if id(node) in out:
                continue
            if ready:
                out[id(node)] = node
            else:
                stack.append((node, True))
                stack += [(p, False) for p in reversed(node.parents)]
        return tuple(out.values())

    def topological_sort(self) -> tuple[Node, ...]:
        return self.nodes

    @property
    def name(self) -> str:
        return "+".join(n.name for n in self.outputs)

    def compute(self, *, runtime: Runtime | None = None):
        """A lazy Panel, or a dict of them by output name; nothing runs until it is collected."""
        panels = (runtime or Runtime()).run(self)
        return next(iter(panels.values())) if len(panels) == 1 else panels

    output = compute

    def spec(self) -> GraphSpec:
        nodes = []
        for n in self.nodes:
            op = n.payload
            own = [p.name for p in n.parents]
            aux = {}
            if n.kind == "transformer":
                aux = dict(zip(op.panels, own[1:])) | ({op.many: own[1 + len(op.panels) :]} if op.many else {})
                own = own[:1]
            config = {} if n.kind == "panel" else {"operation": op.name if isinstance(op, Operator) else op.kind, "parameters": dict(n.params)}
            if n.kind == "prediction_composer":
                config["parameters"] = op.parameters()
                own, aux = own[: op.n_alphas], {"targets": own[op.n_alphas], "availability": own[op.n_alphas + 1]} if len(own) > op.n_alphas else {}
            nodes.append({"name": n.name, "node_type": n.kind, "config": config, "metadata": n.metadata, "inputs": own, "panel_parameters": aux})
        return GraphSpec(tuple(n.name for n in self.outputs), tuple(nodes))

    @staticmethod
    def compile(spec: GraphSpec | dict) -> CompiledGraph:
        return CompiledGraph(spec if isinstance(spec, GraphSpec) else GraphSpec.from_dict(spec))


def _predicts(n: Node) -> bool:
    if n.kind == "panel":
        return isinstance(n.payload, PredictionPanel)
    return n.kind == "prediction_composer" or n.kind == "transformer" and _predicts(n.parents[0])


class Runtime:
    """Keeps lowered plans, so graphs that share nodes share them."""

    def __init__(self) -> None:
        self._plans: dict[int, tuple[Node, Plan]] = {}

    def clear_cache(self) -> None:
        self._plans.clear()

    def run(self, graph: Graph) -> dict[str, Panel]:
        out = {}
        for node in graph.nodes:
            self.plan(node)
        for node in graph.outputs:
            plan = self.plan(node)
            out[node.name] = (PredictionPanel if plan.prediction else Panel)(plan.frame(), plan.domain, traces=tuple(plan.traces), identity=_identity(plan.root_id, plan.value), dense=plan.dense)
        return out

    def plan(self, node: Node) -> Plan:
        had = self._plans.get(id(node))
        if had is None:
            had = self._plans[id(node)] = (node, self._lower(node))
        return had[1]

    def _lower(self, node: Node) -> Plan:
        if node.kind == "panel":
            p = node.payload
            if p.shared is not None:  # a column of a frame that other panels are columns of, too
                wide, identity, column = p.shared
                return Plan(wide, identity, {}, column, {}, p.domain)
            return rooted(p.frame, _identity(p.identity, id(p)), p.domain, p.trace_columns, p.dense, isinstance(p, PredictionPanel))
        plans = [self.plan(p) for p in node.parents]
        if any(not p.domain.equivalent_to(plans[0].domain) for p in plans[1:]):
            raise PanelError("the inputs have different domains")
        if node.kind == "prediction_composer":
            frame = node.payload.predict([p.frame() for p in plans])
            return rooted(frame, _identity("prediction", id(node)), plans[0].domain, (), prediction=True)
        literals = {}
        if node.kind == "composer":
            constant = [p.kind == "transformer" and p.payload.name == "constant" for p in node.parents]
            if not all(constant):
                literals = {i: float(p.params.get("value", 1)) for i, p in enumerate(node.parents) if constant[i]}
                plans = [p for i, p in enumerate(plans) if i not in literals]
        return lower_operator(node.payload, plans, node.params, literals)


@dataclass(frozen=True)
class GraphSpec:
    """A graph as JSON-compatible data; operators by registered name only."""

    outputs: tuple[str, ...]
    nodes: tuple[dict, ...]

    def to_dict(self) -> dict:
        return json.loads(json.dumps({"outputs": list(self.outputs), "nodes": list(self.nodes)}))

    @classmethod
    def from_dict(cls, data: dict) -> GraphSpec:
        if not isinstance(data, dict) or not isinstance(data.get("outputs"), list) or not isinstance(data.get("nodes"), list):
            raise GraphValidationError("a spec has lists `outputs` and `nodes`")
        fields = {"name", "node_type", "config", "metadata", "inputs", "panel_parameters"}
        for n in data["nodes"]:
            if not isinstance(n, dict) or set(n) - fields or not {"name", "node_type"} <= set(n):
                raise GraphValidationError(f"a node has the fields {sorted(fields)}")
            kinds = {"name": str, "node_type": str, "config": dict, "metadata": dict, "inputs": (list, tuple), "panel_parameters": dict}
            if wrong := [f for f in n if not isinstance(n[f], kinds[f])]:
                raise GraphValidationError(f"fields of the wrong kind: {wrong}")
            if not n["name"].strip() or not all(isinstance(x, str) for x in n.get("inputs", ())):
                raise GraphValidationError("names and inputs are non-blank strings")
        spec = cls(tuple(data["outputs"]), tuple({"config": {}, "metadata": {}, "inputs": [], "panel_parameters": {}} | n for n in data["nodes"]))
        spec.validate()
        return spec

    def validate(self) -> None:
        if not self.outputs or not self.nodes:
            raise GraphValidationError("a spec needs outputs and nodes")
        seen: set[str] = set()
        for n in self.nodes:
            refs = [*n["inputs"], *itertools.chain.from_iterable(v if isinstance(v, (list, tuple)) else [v] for v in n["panel_parameters"].values())]
            if n["name"] in seen:
                raise GraphValidationError(f"{n['name']} occurs twice")
            if missing := [r for r in refs if r not in seen]:
                raise GraphValidationError(f"{n['name']} refers to {missing} before they are defined")
            seen.add(n["name"])
            if n["node_type"] != "panel":
                registry = {"transformer": TRANSFORMERS, "composer": COMPOSERS, "prediction_composer": PREDICTIONS}.get(n["node_type"])
                if registry is None:
                    raise GraphValidationError(f"no node type {n['node_type']}")
                try:
                    registry.get(n["config"].get("operation"))
                except KeyError as e:
                    raise GraphValidationError(str(e)) from None
        if missing := [o for o in self.outputs if o not in seen]:
            raise GraphValidationError(f"outputs are undefined: {missing}")


class CompiledGraph:
    """A spec to be bound to panels by name, as often as wanted."""

    def __init__(self, spec: GraphSpec):
        spec.validate()
        self.spec = spec

    def bind(self, panels: dict[str, Panel]) -> Graph:
        nodes: dict[str, Node] = {}
        for n in self.spec.nodes:
            config, aux = n["config"], n["panel_parameters"]
            if n["node_type"] == "panel":
                if n["name"] not in panels:
                    raise GraphValidationError(f"no panel {n['name']} is given")
                nodes[n["name"]] = Node("panel", (), panels[n["name"]], {}, n["name"], n["metadata"])
                continue
            inputs = [Graph(nodes[x]) for x in n["inputs"]]
            if n["node_type"] == "prediction_composer":
                made = PREDICTIONS.get(config["operation"])(**config.get("parameters", {}))
                given = {k: Graph(nodes[v]) for k, v in aux.items()}
                nodes[n["name"]] = made.compose(*inputs, training=tuple(given[k] for k in ("targets", "availability")) if given else None, name=n["name"], metadata=n["metadata"]).outputs[0]
                continue
            op = (TRANSFORMERS if n["node_type"] == "transformer" else COMPOSERS).get(config["operation"])
            extra = {k: [Graph(nodes[x]) for x in v] if isinstance(v, (list, tuple)) else Graph(nodes[v]) for k, v in aux.items()}
            nodes[n["name"]] = make_node(op, tuple(inputs), {**config.get("parameters", {}), **extra}, n["name"], n["metadata"])
        return Graph(*[nodes[o] for o in self.spec.outputs])

    def compute(self, panels: dict[str, Panel], *, runtime: Runtime | None = None):
        return self.bind(panels).compute(runtime=runtime)
