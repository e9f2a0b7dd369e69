"""Conditions on beings, as columns, shared by the fluent builder and the query language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.model import CORE, NUMERIC, EngineError

EPSILON = 2.220446049250313e-16
OPERATORS = {"==": "eq", "eq": "eq", ":": "eq", "!=": "ne", "ne": "ne", ">": "gt", "gt": "gt", "<": "lt", "lt": "lt", ">=": "ge", "gte": "ge", "ge": "ge", "<=": "le", "lte": "le", "le": "le"}


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    """What doesn't meet the condition, beings included that lack its attribute."""

    part: object


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class Between:
    """Both ends belong to it."""

    field: str
    low: object
    high: object


@dataclass(frozen=True)
class Like:
    """A pattern in which % stands for any characters and _ for one; only texts match."""

    field: str
    pattern: str


@dataclass(frozen=True)
class IsNull:
    """The attribute is absent or null."""

    field: str


@dataclass(frozen=True)
class Fields:
    """A comparison of two attributes of a being."""

    field: str
    op: str
    other: str


@dataclass(frozen=True)
class Where:
    """Any condition of one's own: a column, or a function that gets ``attribute`` and gives a column.

    Every column of the beings is kept for it.
    """

    test: object


Condition = Compare | All | Any | Not | In | Between | Like | IsNull | Fields | Where


def attribute(name: str, like: object = None) -> Column:
    """A core field, or else the attribute of that name in ext, typed like a value; null where it is absent."""
    if name in CORE:
        return F.col(name)
    path = f"$.{name}" if name.replace("_", "a").isalnum() else f"$['{name}']"
    kind = "boolean" if isinstance(like, bool) else "double" if isinstance(like, (int, float)) or like is None else "string"
    return F.try_variant_get(F.try_parse_json("ext"), path, kind)


def compare(name: str, op: str, value: object) -> Column:
    """name op value. False rather than null where the attribute is absent or the types don't fit; numbers compare as numbers.

    Equality with a weight allows for EPSILON. An operator that isn't known raises.
    """
    if op not in OPERATORS:
        raise EngineError(f"unknown operator {op!r}")
    op = OPERATORS[op]
    number = _is_number(value)
    if name in CORE and (name in NUMERIC) != number:
        return F.lit(False)
    c, v = attribute(name, value), F.lit(value)
    if op == "eq":
        got = F.abs(c - v) < EPSILON if name == "weight" else c == v
    elif op == "ne":
        got = c != v
    elif not number and name not in CORE:
        return F.lit(False)
    else:
        got = {"gt": c > v, "lt": c < v, "ge": c >= v, "le": c <= v}[op]
    # left as it is, a null drops the row all the same, and the scan can still take the condition
    return got


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def compare_fields(name: str, op: str, other: str) -> Column:
    """name op other, of one being; null or false where either is absent or one is a number and the other a text.

    Two attributes that aren't core fields compare as numbers if both are, else as texts.
    """
    if op not in OPERATORS:
        raise EngineError(f"unknown operator {op!r}")
    sign = OPERATORS[op]
    tests = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b}
    core = [n in NUMERIC for n in (name, other) if n in CORE]
    if len(core) == 2 and core[0] != core[1]:
        return F.lit(False)
    test = tests[sign]
    if core:
        like = 0.0 if core[0] else ""
        return test(attribute(name, like), attribute(other, like))
    x, y = attribute(name, 0.0), attribute(other, 0.0)
    return F.coalesce(test(x, y), test(attribute(name, ""), attribute(other, "")))


def column(cond: Condition) -> Column:
    """The condition as a column; what is null counts as not met."""
    if isinstance(cond, Compare):
        return compare(cond.field, cond.op, cond.value)
    if isinstance(cond, Fields):
        return compare_fields(cond.field, cond.op, cond.other)
    if isinstance(cond, Not):
        return ~F.coalesce(column(cond.part), F.lit(False))
    if isinstance(cond, In):
        parts = [v for v in cond.values if v is not None]
        if cond.field in CORE and cond.field != "weight" and all(_is_number(v) == (cond.field in NUMERIC) for v in parts):
            return F.col(cond.field).isin(parts)
        return column(Any(tuple(Compare(cond.field, "==", v) for v in parts)))
    if isinstance(cond, Between):
        return compare(cond.field, ">=", cond.low) & compare(cond.field, "<=", cond.high)
    if isinstance(cond, Like):
        return F.lit(False) if cond.field in NUMERIC else attribute(cond.field, "").like(cond.pattern)
    if isinstance(cond, IsNull):
        return attribute(cond.field, "").isNull()
    if isinstance(cond, Where):
        return cond.test(attribute) if callable(cond.test) else cond.test
    out = F.lit(isinstance(cond, All)) if not cond.parts else column(cond.parts[0])
    for p in cond.parts[1:]:
        out = out & column(p) if isinstance(cond, All) else out | column(p)
    return out


def fields_of(cond: Condition) -> set[str] | None:
    """The attributes a condition looks at; None if it may be any."""
    if isinstance(cond, Where):
        return None
    if isinstance(cond, Fields):
        return {cond.field, cond.other}
    if isinstance(cond, (All, Any, Not)):
        out: set[str] = set()
        for p in (cond.part,) if isinstance(cond, Not) else cond.parts:
            own = fields_of(p)
            if own is None:
                return None
            out |= own
        return out
    return {cond.field}


def condition_of(name: str, op: str, value: object = None) -> Condition:
    """The condition of a builder's filter: a comparison's sign or name, in, not in, between, like, not like, is null, is not null."""
    word = " ".join(op.lower().split())
    if word.startswith("not "):
        return Not(condition_of(name, word[4:], value))
    if word == "is not null":
        return Not(IsNull(name))
    if word == "is null":
        return IsNull(name)
    if word == "in":
        return In(name, tuple(value))
    if word == "between":
        return Between(name, *value)
    if word == "like":
        return Like(name, value)
    return Compare(name, op, value)
