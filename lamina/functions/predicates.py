"""Typed filters over multi-valued cells, compiled to columns.

A cell is an array of values; it matches if any value does. An empty search matches every value,
null included; any other search never matches null. An empty cell matches nothing.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.hashing import hash_of, number_text

# Operators of each filter type, with their labels.
OPERATORS = {
    "number": ("equals", "notEquals", "greaterThan", "greaterThanOrEquals", "lessThan", "lessThanOrEquals", "between", "expression"),
    "string": ("equals", "notEquals", "startsWith", "endsWith", "contains", "notContains", "regExp"),
    "boolean": ("equals", "notEquals"),
}
LABELS = {
    "en": {"equals": "equals", "notEquals": "not equals", "greaterThan": "greater than", "greaterThanOrEquals": "at least", "lessThan": "less than", "lessThanOrEquals": "at most", "between": "between", "expression": "expression", "startsWith": "starts with", "endsWith": "ends with", "contains": "contains", "notContains": "does not contain", "regExp": "matches"},
    "de": {"equals": "gleich", "notEquals": "ungleich", "greaterThan": "größer als", "greaterThanOrEquals": "mindestens", "lessThan": "kleiner als", "lessThanOrEquals": "höchstens", "between": "zwischen", "expression": "Ausdruck", "startsWith": "beginnt mit", "endsWith": "endet mit", "contains": "enthält", "notContains": "enthält nicht", "regExp": "passt auf"},
}



def operators(type_: str, language: str = "en") -> dict[str, str]:
    """The operators of a filter type with their labels; an unknown type has those of text."""
    return {o: LABELS[language][o] for o in OPERATORS.get(type_, OPERATORS["string"])}


@dataclass(frozen=True)
class ColumnFilter:
    """One column's filter. An unknown type is treated as text."""

    column: str
    operator: str
    search: object = None
    type: str = "string"
    match_case: bool = False

    def model(self) -> dict:
        own = {"column": self.column.strip("/"), "operator": self.operator, "search": self.search, "type": self.type}
        return {**own, "matchCase": True} if self.match_case else own

    @property
    def hash(self) -> str:
        return hash_of(self.model())

    def value_matches(self, value: Column, kind: T.DataType) -> Column:
        make = {"number": number_predicate, "boolean": boolean_predicate}.get(self.type)
        return make(value, self.operator, self.search) if make else string_predicate(value, kind, self.operator, self.search, self.match_case)

    def cell_matches(self, cell: Column, kind: T.ArrayType) -> Column:
        """True or false, never null."""
        hit = F.exists(cell, lambda v: F.coalesce(self.value_matches(v, kind.elementType), F.lit(False)))
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class RowFilter:
    """Column filters joined by `and` or `or`; several filters of one column all count."""

    filters: tuple[ColumnFilter, ...] = field(default_factory=tuple)
    how: str = "and"

    def matches(self, cells: dict[str, tuple[Column, T.ArrayType]]) -> Column | None:
        """None where there is nothing to filter by."""
        unknown = sorted({f.column.strip("/") for f in self.filters} - set(cells))
        if unknown:
            raise ValueError(f"no such columns: {unknown}; available: {sorted(cells)}")
        tests = [f.cell_matches(*cells[f.column.strip("/")]) for f in self.filters]
        return reduce((lambda a, b: a & b) if self.how == "and" else (lambda a, b: a | b), tests) if tests else None


# ---------------------------------------------------------------- numbers

def as_number(search: object) -> float | None:
    """The number a search stands for: leading digits of a text count; None matches all."""
    if search is None or isinstance(search, bool):
        return None
    if isinstance(search, (int, float)):
        return float(search)
    found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", str(search))
    return float(found[1]) if found else None


def number_predicate(value: Column, operator: str, search: object) -> Column:
    if operator == "expression":
        return expression(value, search)
    if operator == "between":
        low, high = (as_number(x) for x in search)
        return value.between(low, high) & ~F.isnan(value.cast("double"))
    number = as_number(search)
    if number is None:
        return F.lit(True)
    # NaN compares false here, as in the source's arithmetic; Spark alone would order it last
    real = value.isNotNull() & ~F.isnan(value.cast("double"))
    tests = {"equals": value == number, "notEquals": value != number, "greaterThan": value > number, "greaterThanOrEquals": value >= number, "lessThan": value < number, "lessThanOrEquals": value <= number}
    if operator not in tests:
        raise ValueError(f"unknown number operator {operator}")
    return tests[operator] & (real if operator != "notEquals" else value.isNotNull())


_BINARY = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__"}
_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def expression(value: Column, text: object) -> Column:
    """Comparisons, and/or/not and arithmetic over the variable `v`; digits alone mean equality.

    Only names and operators of this list compile; anything else never matches.
    """
    source = str(text if text is not None else "").strip()
    if not source:
        return F.lit(True)
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", source):
        return value == float(source)

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.BoolOp(op=op, values=values):
                return reduce((lambda a, b: a & b) if isinstance(op, ast.And) else (lambda a, b: a | b), map(build, values))
            case ast.UnaryOp(op=ast.Not(), operand=operand):
                return ~build(operand)
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -build(operand)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return getattr(build(left), _BINARY[type(op)])(build(right))
            case ast.Compare(left=left, ops=ops, comparators=rights) if all(type(o) in _COMPARE for o in ops):
                sides = [left, *rights]
                return reduce(lambda a, b: a & b, (getattr(build(a), _COMPARE[type(o)])(build(b)) for a, o, b in zip(sides, ops, rights, strict=False)))
            case ast.Name(id="v"):
                return value
            case ast.Constant(value=bool() as flag):
                return F.lit(flag)
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
        raise ValueError(source)

    try:
        tree = ast.parse(source, mode="eval")
        if not isinstance(tree.body, (ast.BoolOp, ast.Compare, ast.UnaryOp, ast.Constant)) or (isinstance(tree.body, ast.UnaryOp) and not isinstance(tree.body.op, ast.Not)):
            raise ValueError(source)
        return value.isNotNull() & build(tree)
    except (ValueError, SyntaxError):
        return F.lit(False)


# ---------------------------------------------------------------- text

def normalized(value: Column, match_case: bool) -> Column:
    """Spaces (U+0020) never count; case only if asked for."""
    return F.replace(value if match_case else F.lower(value), F.lit(" "), F.lit(""))


def _valid_pattern(pattern: str) -> bool:
    """Whether Spark's own expressions take a pattern; it is tried on an empty text when the plan is made."""
    try:
        SparkSession.active().sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).first()
    except PySparkException:
        return False
    return True


def string_predicate(value: Column, kind: T.DataType, operator: str, search: object, match_case: bool = False) -> Column:
    if search is None or search == "":
        return F.lit(True)
    text = value if isinstance(kind, T.StringType) else number_text(value, kind) if isinstance(kind, T.NumericType) else value.cast("string")
    own = normalized(text, match_case)
    if operator == "regExp":
        return own.rlike(str(search)) if _valid_pattern(str(search)) else F.lit(False)
    wanted = (str(search) if match_case else str(search).lower()).replace(" ", "")
    tests = {"equals": own == wanted, "notEquals": own != wanted, "startsWith": own.startswith(wanted), "endsWith": own.endswith(wanted), "contains": own.contains(wanted), "notContains": ~own.contains(wanted)}
    if operator not in tests:
        raise ValueError(f"unknown text operator {operator}")
    return tests[operator]


# ---------------------------------------------------------------- booleans

def as_boolean(search: object) -> bool | None:
    """Words for yes and no in two languages by their first letter, numbers by being other than 0; None matches all."""
    if search is None or isinstance(search, bool):
        return search
    if isinstance(search, (int, float)):
        return search != 0
    text = str(search).strip().lower()
    if text[:1] in ("t", "j", "y"):
        return True
    if text[:1] in ("n", "f"):
        return False
    return float(text) != 0 if re.fullmatch(r"\d+", text) else False


def boolean_predicate(value: Column, operator: str, search: object) -> Column:
    """Cells that hold neither a truth value nor text that reads as one are unequal to both searches."""
    wanted = as_boolean(search)
    if wanted is None:
        return F.lit(True)
    text = F.lower(value.cast("string"))
    number = text.try_cast("double")
    truth = F.when(text.isin("true", "yes"), F.lit(True)).when(text == "false", F.lit(False)).when(number.isNotNull(), number != 0)
    equal = F.coalesce(truth == wanted, F.lit(False))
    return F.when(value.isNotNull(), equal if operator == "equals" else ~equal)
