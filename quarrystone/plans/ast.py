"""What the parser makes of a text."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Literal:
    value: int | float | str

    def __str__(self) -> str:
        return "'" + self.value.replace("'", "\\'") + "'" if isinstance(self.value, str) else str(self.value)


Operand = Name | Literal


@dataclass(frozen=True)
class Comparison:
    left: Operand
    op: str  # < > =
    right: Operand

    @property
    def names(self) -> list[str]:
        return [x.text for x in (self.left, self.right) if isinstance(x, Name)]

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Or:
    parts: tuple[Comparison, ...]

    @property
    def names(self) -> list[str]:
        return [n for p in self.parts for n in p.names]

    def __str__(self) -> str:
        return "(" + " OR ".join(map(str, self.parts)) + ")"


Cnf = tuple[Or, ...]


@dataclass(frozen=True)
class Negate:
    inner: Expr

    def __str__(self) -> str:
        return f"-{self.inner}"


@dataclass(frozen=True)
class Binary:
    left: Expr
    op: str  # + - * /
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


Expr = Name | Literal | Negate | Binary


def names_in(e: Expr) -> list[str]:
    if isinstance(e, Name):
        return [e.text]
    if isinstance(e, Negate):
        return names_in(e.inner)
    return names_in(e.left) + names_in(e.right) if isinstance(e, Binary) else []


@dataclass(frozen=True)
class Query:
    tables: tuple[tuple[str, str], ...]  # (table, alias) in written order
    where: Cnf
    columns: tuple[str, ...] = ()
    distinct: bool = False
    total: Expr | None = None
    total_distinct: bool = False
    group_by: tuple[str, ...] = field(default=())
