"""Operators by name.

An operator is a function ``(corpus, spec) -> corpus`` (a source starts from an empty
corpus); its name is the tag that a workflow uses.  Attributes are checked when the
workflow is built, before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

OPERATORS: dict[str, Operator] = {}


def as_bool(text: str | bool | None) -> bool:
    """None is false; true/false in any case; other text is an error."""
    if text is None or isinstance(text, bool):
        return bool(text)
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    raise ValueError(f"not a boolean: {text!r}")


@dataclass
class Spec:
    """One step: its operator's name, attributes, and nested elements as further steps."""

    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Spec] = field(default_factory=list)

    def get(self, name: str, default=None, kind=str):
        value = self.attributes.get(name)
        if value is None:
            return default
        return as_bool(value) if kind is bool else kind(value)

    def all(self, name: str) -> list[Spec]:
        return [c for c in self.children if c.name == name]


@dataclass
class Operator:
    name: str
    run: Callable
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    also: Callable | None = None  # raises for values that can't be run

    def check(self, spec: Spec) -> None:
        lacks = [r for r in self.required if r not in spec.attributes]
        if lacks:
            raise ValueError(f"{spec.name} lacks {', '.join(lacks)}")
        unknown = sorted(spec.attributes.keys() - {*self.required, *self.optional, "text"})
        if unknown:
            raise ValueError(f"{spec.name} knows no {', '.join(unknown)}")
        if self.also is not None:
            self.also(spec)


def operator(name: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = (), also: Callable | None = None):
    """Register a function under a name; also(spec) raises for values that can't be run."""

    def put(f):
        if name in OPERATORS:
            raise ValueError(f"two operators named {name}")
        OPERATORS[name] = Operator(name, f, required, optional, also)
        return f

    return put
