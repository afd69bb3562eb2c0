"""What statements are parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Now:
    pass


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Over:
    partition: tuple[Any, ...]
    order: tuple[tuple[Any, bool], ...]  # expression, descending


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]
    params: tuple[Any, ...] | None = None  # quantile(0.5)(x)
    distinct: bool = False
    where: Any = None  # FILTER
    over: Over | None = None


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Un:
    op: str
    of: Any


@dataclass(frozen=True)
class Case:
    whens: tuple[tuple[Any, Any], ...]
    other: Any


@dataclass(frozen=True)
class InList:
    of: Any
    values: tuple[Any, ...]


@dataclass(frozen=True)
class InSelect:
    of: Any
    table: str
    where: Any


@dataclass(frozen=True)
class Between:
    of: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class Like:
    of: Any
    pattern: str
    any_case: bool


@dataclass(frozen=True)
class Segment:
    view: str


@dataclass(frozen=True)
class Sampled:
    """One record in n, by its id."""

    n: int


@dataclass
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclass
class Join:
    how: str
    table: str
    alias: str
    left: Col
    right: Col


@dataclass
class Order:
    expr: Any
    descending: bool


@dataclass
class Select:
    items: list[Item]
    table: str
    alias: str
    joins: list[Join] = field(default_factory=list)
    where: Any = None
    group: list[Any] = field(default_factory=list)
    sets: list[tuple[int, ...]] | None = None  # grouping sets as places in group
    having: Any = None
    order: list[Order] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    ties: bool = False
    sample: int | None = None
    numbers: int | None = None
    distinct: bool = False
    grouped_as_written: bool = True


@dataclass
class Query:
    branches: list[Select]
    format: str = "JSON"
    settings: dict[str, int] = field(default_factory=dict)


@dataclass
class Statement:
    """Everything but a query: what it does, and its parts by name."""

    verb: str
    parts: dict[str, Any]
