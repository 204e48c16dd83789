"""Syntax tree.  Expressions are `Expr(op, args)`; patterns and statements have classes of their own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Expr:
    op: str
    args: list = field(default_factory=list)
    text: str = ""

    def walk(self) -> Iterator[Expr]:
        yield self
        stack = list(self.args)
        while stack:
            a = stack.pop()
            if isinstance(a, Expr):
                yield from a.walk()
            elif isinstance(a, (list, tuple)):
                stack.extend(a)


@dataclass
class Node:
    var: str
    label: Expr | None = None
    props: list[tuple[str, Expr]] = field(default_factory=list)
    where: Expr | None = None
    named: bool = True


@dataclass
class Edge:
    var: str
    direction: str  # out, in, any
    label: Expr | None = None
    props: list[tuple[str, Expr]] = field(default_factory=list)
    where: Expr | None = None
    named: bool = True
    low: int | None = None  # quantifier; None: exactly one edge
    high: int | None = None
    optional: bool = False


@dataclass
class Group:
    """A parenthesised subpath, perhaps quantified."""

    path: Path
    low: int = 1
    high: int | None = 1
    where: Expr | None = None


@dataclass
class Path:
    items: list  # Node, Edge, Group
    var: str | None = None
    mode: str = "WALK"
    search: tuple[str, int] = ("ALL", 0)  # ALL, ANY k, ALL SHORTEST, SHORTEST k, SHORTEST k GROUP
    alternatives: list[Path] = field(default_factory=list)
    multiset: bool = False


@dataclass
class Match:
    paths: list[Path]
    where: Expr | None = None
    optional: bool = False
    different_edges: bool = False
    yields: list[str] | None = None


@dataclass
class Block:
    """OPTIONAL { MATCH ... MATCH ... }"""

    matches: list[Match]
    optional: bool = True


@dataclass
class Let:
    items: list[tuple[str, Expr]]


@dataclass
class For:
    var: str
    source: Expr
    counter: tuple[str, int] | None = None  # name and first value


@dataclass
class Filter:
    where: Expr


@dataclass
class Call:
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]] | None = None
    optional: bool = False
    inline: Query | None = None
    scope: list[str] | None = None  # variables that an inline query sees; None: all


@dataclass
class Use:
    graph: str | None


@dataclass
class SortKey:
    expr: Expr
    ascending: bool = True
    nulls_first: bool = False


@dataclass
class OrderBy:
    keys: list[SortKey] = field(default_factory=list)
    offset: Expr | int | None = None
    limit: Expr | int | None = None
    approximate: bool = False


@dataclass
class Return:
    items: list[tuple[Expr, str]]
    star: bool = False
    distinct: bool = False
    group: list[Expr] | None = None
    having: Expr | None = None
    order: OrderBy | None = None
    finish: bool = False


@dataclass
class Linear:
    parts: list


@dataclass
class SetOp:
    op: str  # UNION, EXCEPT, INTERSECT, OTHERWISE
    all: bool
    left: Query
    right: Query


@dataclass
class Chain:
    """Statements joined by NEXT; each with the columns it passes on."""

    steps: list[tuple[Query, list[tuple[str, str]] | None]]


@dataclass
class Command:
    """Session, transaction, catalog and explain statements: name and arguments."""

    name: str
    args: dict


Query = Linear | SetOp | Chain
