"""Flow definitions: an immutable builder, structural shapes and a registry.

A flow is a graph of ``single`` and ``map`` steps over one input.  Building a flow
touches no data; ``plans.batch`` turns it into a DataFrame plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from itertools import zip_longest
from typing import Any

from loomspark.functions.scalars import MAX_SLUG, RESERVED_SLUGS

MODES = ("fail", "skip", "skip-cascade")
DEFAULTS = {"max_attempts": 3, "base_delay": 5, "timeout": 60}
#: Least values of the runtime options.
LEAST = {"max_attempts": 1, "base_delay": 1, "timeout": 3, "start_delay": 0}
_SLUG = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def check_slug(slug: str) -> str:
    if not slug or len(slug) > MAX_SLUG or slug in RESERVED_SLUGS or not _SLUG.fullmatch(slug):
        raise ValueError(f"not a usable slug: {slug!r}")
    return slug


def check_options(options: Mapping[str, int | None], step: bool) -> dict[str, int]:
    """The options that are set, after a check of their least values."""
    found = {}
    for name, value in options.items():
        if name not in LEAST or name == "start_delay" and not step:
            raise ValueError(f"unknown option: {name}")
        if value is None:
            continue
        if not isinstance(value, int) or isinstance(value, bool) or value < LEAST[name]:
            raise ValueError(f"{name} must be an integer of at least {LEAST[name]}")
        found[name] = value
    return found


def check_pattern(pattern: Any) -> dict | None:
    if pattern is not None and not isinstance(pattern, dict):
        raise ValueError("a condition's pattern must be an object")
    return pattern


@dataclass(frozen=True)
class Step:
    slug: str
    handler: Callable
    kind: str = "single"
    depends_on: tuple[str, ...] = ()
    if_: dict | None = None
    if_not: dict | None = None
    when_unmet: str = "skip"
    when_exhausted: str = "fail"
    options: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Flow:
    """Immutable: ``step``, ``array`` and ``map`` return a new flow with one step more."""

    slug: str
    options: Mapping[str, int] = field(default_factory=dict)
    steps: tuple[Step, ...] = ()

    def __post_init__(self) -> None:
        check_slug(self.slug)
        object.__setattr__(self, "options", check_options(self.options, step=False))

    def _with(self, step: Step) -> Flow:
        check_slug(step.slug)
        known = {s.slug for s in self.steps}
        if step.slug in known:
            raise ValueError(f"step {step.slug!r} is there already")
        for dep in step.depends_on:
            if dep not in known:
                raise ValueError(f"step {step.slug!r} depends on unknown step {dep!r}")
        if step.kind == "map" and len(step.depends_on) > 1:
            raise ValueError("a map has one source at most")
        if step.when_unmet not in MODES or step.when_exhausted not in MODES:
            raise ValueError(f"modes are {', '.join(MODES)}")
        return replace(self, steps=(*self.steps, step))

    def step(self, slug: str, handler: Callable, depends_on: list[str] | tuple[str, ...] = (), *, if_: dict | None = None, if_not: dict | None = None, when_unmet: str = "skip", when_exhausted: str = "fail", **options: int) -> Flow:
        return self._with(Step(slug, handler, "single", tuple(depends_on), check_pattern(if_), check_pattern(if_not), when_unmet, when_exhausted, check_options(options, step=True)))

    #: A step that gives an array is a plain step.
    array = step

    def map(self, slug: str, handler: Callable, array: str | None = None, *, if_: dict | None = None, if_not: dict | None = None, when_unmet: str = "skip", when_exhausted: str = "fail", **options: int) -> Flow:
        """One task per element of ``array``'s output, or of the flow's input where there is none."""
        return self._with(Step(slug, handler, "map", (array,) if array else (), check_pattern(if_), check_pattern(if_not), when_unmet, when_exhausted, check_options(options, step=True)))

    def get(self, slug: str) -> Step:
        for s in self.steps:
            if s.slug == slug:
                return s
        raise KeyError(slug)

    def option(self, step: Step, name: str) -> int | None:
        """A step's option, else the flow's, else the default."""
        return step.options.get(name, self.options.get(name, DEFAULTS.get(name)))

    def leaves(self) -> list[Step]:
        inner = {d for s in self.steps for d in s.depends_on}
        return [s for s in self.steps if s.slug not in inner]

    def waves(self) -> list[list[Step]]:
        """Steps by longest path from a root, each wave in definition order."""
        depth: dict[str, int] = {}
        for s in self.steps:
            depth[s.slug] = max((depth[d] + 1 for d in s.depends_on), default=0)
        return [[s for s in self.steps if depth[s.slug] == w] for w in range(max(depth.values(), default=-1) + 1)]


def shape(flow: Flow) -> dict:
    """What makes two flows the same graph; retries and timeouts do not."""
    wrapped = lambda p: {"defined": p is not None, **({"value": p} if p is not None else {})}
    return {
        "steps": [
            {"slug": s.slug, "stepType": s.kind, "dependencies": sorted(s.depends_on), "whenUnmet": s.when_unmet, "whenExhausted": s.when_exhausted, "requiredInputPattern": wrapped(s.if_), "forbiddenInputPattern": wrapped(s.if_not)}
            for s in flow.steps
        ]
    }


#: What two steps at the same place of two shapes must agree in.
COMPARED = ("slug", "stepType", "dependencies", "whenUnmet", "whenExhausted", "requiredInputPattern", "forbiddenInputPattern")


def compare_shapes(a: dict, b: dict) -> list[dict]:
    """Where two shapes differ, as (index, field, first, second); empty when they are equal.

    Unequal lengths are one difference of the field ``steps``; a step that only
    one side has is one of the field ``slug`` with nothing on the other side.
    """
    sides = a["steps"], b["steps"]
    found = []

    def note(index: int | None, field_: str, first: Any, second: Any) -> None:
        if first != second:
            found.append({"index": index, "field": field_, "first": first, "second": second})

    note(None, "steps", *map(len, sides))
    for index, (x, y) in enumerate(zip_longest(*sides)):
        fields = COMPARED if x and y else ("slug",)
        for name in fields:
            note(index, name, x and x[name], y and y[name])
    return found


def compile_flow(flow: Flow) -> list[str]:
    """The definition as SQL calls: one for the flow and one a step in order; only options that are set."""
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    names = {"max_attempts": "max_attempts", "base_delay": "base_delay", "timeout": "timeout", "start_delay": "start_delay"}
    opts = lambda o: "".join(f", {names[k]} => {v}" for k, v in o.items())
    out = [f"SELECT create_flow({quote(flow.slug)}{opts(flow.options)});"]
    for s in flow.steps:
        deps = f", ARRAY[{', '.join(map(quote, s.depends_on))}]" if s.depends_on else ""
        more = ", step_type => 'map'" if s.kind == "map" else ""
        for name, pattern in (("required_input_pattern", s.if_), ("forbidden_input_pattern", s.if_not)):
            more += f", {name} => {quote(json.dumps(pattern))}" if pattern is not None else ""
        more += f", when_unmet => {quote(s.when_unmet)}" if s.when_unmet != "skip" else ""
        more += f", when_exhausted => {quote(s.when_exhausted)}" if s.when_exhausted != "fail" else ""
        out.append(f"SELECT add_step({quote(flow.slug)}, {quote(s.slug)}{deps}{opts(s.options)}{more});")
    return out


class FlowRegistry:
    """Flows by slug, with the drift check of a shape stored earlier."""

    def __init__(self, *flows: Flow) -> None:
        self.flows: dict[str, Flow] = {}
        self.stored: dict[str, dict] = {}
        for flow in flows:
            self.add(flow)

    def add(self, flow: Flow) -> None:
        if flow.slug in self.flows:
            raise ValueError(f"flow {flow.slug!r} is registered already")
        self.flows[flow.slug] = flow

    def get(self, slug: str) -> dict:
        """A flow's compiled statements, as its catalog entry."""
        if slug not in self.flows:
            raise KeyError(f"no flow {slug!r}")
        return {"flowSlug": slug, "sql": compile_flow(self.flows[slug])}

    def ensure_compiled(self, flow: Flow, allow_data_loss: bool = False) -> dict:
        """compiled, verified, recompiled or mismatch, with the differences to the stored shape."""
        now, before = shape(flow), self.stored.get(flow.slug)
        if before is None:
            self.stored[flow.slug] = now
            return {"status": "compiled", "differences": []}
        found = compare_shapes(before, now)
        if not found:
            return {"status": "verified", "differences": []}
        if allow_data_loss:
            self.stored[flow.slug] = now
            return {"status": "recompiled", "differences": found}
        return {"status": "mismatch", "differences": found}
