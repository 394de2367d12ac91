"""Predicates and arithmetic of the dialect as Spark Columns, typed by the schema they run on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ResolutionError, TypeMismatch
from ..plans.ast import Binary, Cnf, Comparison, Expr, Literal, Name, Negate, Operand, Or

_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIME = (T.TimestampNTZType, T.TimestampType, T.DateType)


class Scope:
    """Names that an expression may use: columns by their dialect name, which may stand for another column."""

    def __init__(self, df: DataFrame, names: dict[str, str] | None = None):
        types = {f.name: f.dataType for f in df.schema.fields}
        if len(types) != len(df.columns):
            raise ResolutionError("column names repeat")
        self.columns = names or {c: c for c in df.columns}
        self.types = {n: types[c] for n, c in self.columns.items()}

    def find(self, name: str) -> str:
        """The dialect name that `name` means: itself, or the only one that ends in it."""
        if name in self.columns:
            return name
        found = [n for n in self.columns if n.rpartition(".")[2] == name]
        if len(found) != 1:
            raise ResolutionError(f"{'ambiguous' if found else 'unknown'} attribute {name}")
        return found[0]

    def has(self, name: str) -> bool:
        try:
            return bool(self.find(name))
        except ResolutionError:
            return False

    def column(self, name: str) -> Column:
        return F.col(f"`{self.columns[self.find(name)]}`")

    def type(self, name: str) -> T.DataType:
        return self.types[self.find(name)]


def _kind(x: Operand, scope: Scope) -> str:
    if isinstance(x, Literal):
        return {int: "Int", float: "Double", str: "String"}[type(x.value)]
    t = scope.type(x.text)
    return "Int" if isinstance(t, _INT) else "Double" if isinstance(t, (T.DoubleType, T.FloatType)) else "Time" if isinstance(t, _TIME) else "String"


def _operand(x: Operand, other: Operand, scope: Scope) -> Column:
    if isinstance(x, Name):
        return scope.column(x.text)
    if isinstance(other, Name) and _kind(other, scope) == "Time":
        date = "-".join(p.zfill(2) for p in str(x.value).split("-")) if " " not in str(x.value) else str(x.value)
        return F.lit(date).cast(scope.type(other.text))
    return F.lit(x.value)


def comparison(c: Comparison, scope: Scope, strict_types: bool = False) -> Column:
    left, right = _kind(c.left, scope), _kind(c.right, scope)
    numbers = {"Int", "Double"}
    fits = left == right or {left, right} <= numbers and not strict_types or {left, right} == {"Time", "String"}
    if not fits:
        raise TypeMismatch(f"{c}: {left} and {right}")
    a, b = _operand(c.left, c.right, scope), _operand(c.right, c.left, scope)
    return {"<": a < b, ">": a > b, "=": a == b}[c.op]


def any_of(part: Or, scope: Scope, strict_types: bool = False) -> Column:
    return reduce(lambda a, b: a | b, (comparison(c, scope, strict_types) for c in part.parts))


def predicate(cnf: Cnf, scope: Scope, strict_types: bool = False) -> Column:
    return reduce(lambda a, b: a & b, (any_of(p, scope, strict_types) for p in cnf), F.lit(True)) if cnf else F.lit(True)


def arithmetic(e: Expr, scope: Scope) -> tuple[Column, str]:
    """The Column of an expression and whether it is Int or Double. Int by Int divides to an Int, towards zero."""
    if isinstance(e, Literal):
        return F.lit(e.value), _kind(e, scope)
    if isinstance(e, Name):
        kind = _kind(e, scope)
        if kind not in ("Int", "Double"):
            raise TypeMismatch(f"{e.text} is no number")
        return scope.column(e.text), kind
    if isinstance(e, Negate):
        inner, kind = arithmetic(e.inner, scope)
        return -inner, kind
    (a, ka), (b, kb) = arithmetic(e.left, scope), arithmetic(e.right, scope)
    kind = "Int" if ka == kb == "Int" else "Double"
    if kind == "Int":  # wide enough not to wrap
        a, b = a.cast("long"), b.cast("long")
    else:
        a, b = a.cast("double"), b.cast("double")
    if e.op == "/":
        return (F.call_function("div", a, b) if kind == "Int" else a / b), kind
    return {"+": a + b, "-": a - b, "*": a * b}[e.op], kind
