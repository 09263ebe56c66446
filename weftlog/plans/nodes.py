"""The tree of a query: expressions and steps."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Path:
    """a.b[0].c as ((name, (index, ...)), ...)."""

    parts: tuple[tuple[str, tuple[int, ...]], ...]

    def __str__(self) -> str:
        return ".".join(n + "".join(f"[{i}]" for i in ix) for n, ix in self.parts)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.parts)


@dataclass(frozen=True)
class Lit:
    """kind: int, float, bool, string, timespan (microseconds), datetime or null."""

    kind: str
    value: Any

    def __str__(self) -> str:
        return {"string": lambda: '"' + str(self.value).replace('"', '\\"') + '"', "bool": lambda: str(self.value).lower(), "null": lambda: "null", "timespan": lambda: f"{self.value}micros", "datetime": lambda: f"datetime({self.value})"}.get(self.kind, lambda: str(self.value))()


@dataclass(frozen=True)
class Call:
    """An operator or function: name and arguments."""

    name: str
    args: tuple

    def __str__(self) -> str:
        if len(self.args) == 2 and not self.name.isalpha() or self.name in ("and", "or", "contains", "startswith", "endswith", "has", "has_cs"):
            return f"({self.args[0]} {self.name} {self.args[1]})"
        if self.name == "in":
            return f"({self.args[0]} in ({', '.join(map(str, self.args[1:]))}))"
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Item:
    """[target =] expression."""

    target: Path | None
    expr: Any

    def __str__(self) -> str:
        return f"{self.target}={self.expr}" if self.target else str(self.expr)


@dataclass(frozen=True)
class SortKey:
    path: Path
    desc: bool = False
    nulls_first: bool = False

    def __str__(self) -> str:
        return f"{self.path} {'desc' if self.desc else 'asc'} nulls {'first' if self.nulls_first else 'last'}"


@dataclass(frozen=True)
class Agg:
    target: Path | None
    name: str
    arg: Any = None

    def __str__(self) -> str:
        call = f"{self.name}({'' if self.arg is None else self.arg})"
        return f"{self.target}={call}" if self.target else call


@dataclass(frozen=True)
class Step:
    """One step of a pipeline; what args holds depends on the kind."""

    kind: str
    args: dict = field(default_factory=dict)

    def __str__(self) -> str:
        def show(v: Any) -> str:
            if isinstance(v, Query):
                return "(" + " | ".join(map(str, v.steps)) + ")"
            return ", ".join(map(show, v)) if isinstance(v, (list, tuple)) else str(v)

        return self.kind + "".join(f" {k}={show(v)}" for k, v in self.args.items() if v not in (None, (), []))


@dataclass(frozen=True)
class Query:
    lets: tuple[tuple[str, Query], ...]
    steps: tuple[Step, ...]
