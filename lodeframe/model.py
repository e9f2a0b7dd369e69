"""The entity model: table schemas, definitions with typed fields, relation types, errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

OPEN_TX = 9223372036854775807

BEINGS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("def", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
        T.StructField("tx_begin", T.LongType()),
        T.StructField("tx_end", T.LongType()),
        T.StructField("ext", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)
RELATIONS = T.StructType(
    [
        T.StructField("from_id", T.StringType()),
        T.StructField("to_id", T.StringType()),
        T.StructField("relation_type", T.IntegerType()),
        T.StructField("directed", T.BooleanType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("ord", T.LongType()),
    ]
)
VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("ord", T.LongType()),
    ]
)
TXLOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("tx_id", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("crc32", T.LongType()),
    ]
)

#: Values of a new being for core fields that aren't given.
CORE_DEFAULTS = {"status": 0, "name": "", "code": "", "description": "", "weight": 0.0, "priority": 0, "category": "", "created_at": 0, "updated_at": 0, "tx_begin": 0, "tx_end": None, "ext": None}
CORE = tuple(f.name for f in BEINGS if f.name != "ord")
NUMERIC = frozenset({"status", "weight", "priority", "created_at", "updated_at", "tx_begin", "tx_end"})
#: Capacities in bytes of the fixed-width record form, for those who want values cut to it.
WIDTHS = {"def": 64, "name": 64, "code": 32, "description": 128, "category": 16}


class EngineError(Exception):
    """Base of all errors."""


class DslSyntaxError(EngineError):
    """A query text that isn't in the language."""


class NotFound(EngineError):
    """A record that is required doesn't exist."""


class DimensionMismatch(EngineError):
    """A vector of another dimension than its field."""


class InvalidState(EngineError):
    """A request that can't be met, such as a path between unconnected nodes."""


class ConstraintViolation(EngineError):
    """A value against its definition."""


_TYPE = re.compile(r"\s*(String|Int|Float|Bool|Array|Map|[<>(),])", re.I)


@dataclass(frozen=True)
class FieldType:
    """String, Int, Float, Bool, Array<T> or Map<String, T>."""

    kind: str
    inner: FieldType | None = None

    @staticmethod
    def parse(text: str) -> FieldType:
        words, at = [], 0
        while at < len(text.rstrip()):
            m = _TYPE.match(text, at)
            if not m:
                raise ConstraintViolation(f"unknown field type {text!r}")
            words.append(m.group(1))
            at = m.end()
        kind, rest = FieldType._read(words)
        if rest:
            raise ConstraintViolation(f"unknown field type {text!r}")
        return kind

    @staticmethod
    def _read(words: list[str]) -> tuple[FieldType, list[str]]:
        if not words:
            raise ConstraintViolation("empty field type")
        kind = words[0].capitalize()
        if kind == "Array":
            inner, rest = FieldType._read(words[2:])
            return FieldType("Array", inner), rest[1:]
        if kind == "Map":
            key, rest = FieldType._read(words[2:])
            if key.kind != "String":
                raise ConstraintViolation("the keys of a Map are strings")
            inner, rest = FieldType._read(rest[1:])
            return FieldType("Map", inner), rest[1:]
        if kind not in ("String", "Int", "Float", "Bool"):
            raise ConstraintViolation(f"unknown field type {words[0]!r}")
        return FieldType(kind), words[1:]

    def __str__(self) -> str:
        return {"Array": f"Array<{self.inner}>", "Map": f"Map<String,{self.inner}>"}.get(self.kind, self.kind)


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    required: bool = False
    default: object = None
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Def:
    name: str
    fields: tuple[Field, ...] = ()
    type_code: int = 0


@dataclass
class DefRegistry:
    """Definitions by name and code. Codes count from 1; defining a name again keeps the first definition."""

    defs: dict[str, Def] = field(default_factory=dict)

    def register(self, d: Def) -> Def:
        if d.name not in self.defs:
            self.defs[d.name] = replace(d, type_code=len(self.defs) + 1)
        return self.defs[d.name]

    def get_or_register(self, name: str) -> Def:
        return self.register(Def(name))

    def by_name(self, name: str) -> Def | None:
        return self.defs.get(name)

    def by_code(self, code: int) -> Def | None:
        return next((d for d in self.defs.values() if d.type_code == code), None)

    def all(self) -> list[Def]:
        return list(self.defs.values())


@dataclass(frozen=True)
class RelationType:
    code: int
    name: str
    directed: bool = True


@dataclass
class RelationTypes:
    """Relation types by code and name; the first registration of a code wins."""

    types: dict[int, RelationType] = field(default_factory=dict)

    def register(self, t: RelationType) -> RelationType:
        return self.types.setdefault(t.code, t)

    def by_name(self, name: str) -> RelationType | None:
        return next((t for t in self.types.values() if t.name == name), None)
