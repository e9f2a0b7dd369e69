"""Definitions as conditions: rows that violate them come out as a table of violations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.model import Def, Field, FieldType

_NUMBER = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\s*\d+\))"


def type_pattern(t: FieldType) -> str:
    """A pattern that the schema of a JSON value matches if the value is of the type."""
    if t.kind == "Array":
        return rf"ARRAY<(?:VOID|{type_pattern(t.inner)})>"
    if t.kind == "Map":
        return rf"OBJECT<(?:(?:`[^`]*`|[^:,<>]+): {type_pattern(t.inner)}(?:, )?)*>"
    return {"String": "STRING", "Int": "BIGINT", "Float": _NUMBER, "Bool": "BOOLEAN"}[t.kind]


def _value(ext: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.try_parse_json(ext), "$[" + json.dumps(name) + "]", kind)


def problem(f: Field, ext: Column) -> Column:
    """Null, or what is wrong with the field in a JSON text: missing, type or range.

    Only a required field may be missing. A range holds if both ends are set and is for numbers. JSON 1.0 is no Int.
    """
    v = _value(ext, f.name)
    schema = F.schema_of_variant(v)
    bad_type = ~schema.rlike(f"^{type_pattern(f.type)}$")
    out = F.when(v.isNull(), F.lit("missing") if f.required else F.lit(None).cast("string")).when(bad_type, F.lit("type"))
    if f.min is not None and f.max is not None:
        number = _value(ext, f.name, "double")
        out = out.when(number.isNull() | ~number.between(f.min, f.max), F.lit("range"))
    return out


def violations(beings: DataFrame, definitions: list[Def], keys: list[str]) -> DataFrame:
    """keys, def, field, problem: one row per violation. Beings of other definitions have none.

    The definitions become one expression, so the table is read once and nothing is shuffled.
    """
    checks = F.array().cast("array<struct<field:string,problem:string>>")
    for d in definitions:
        if d.fields:
            own = F.array(*[F.struct(F.lit(f.name).alias("field"), problem(f, F.col("ext")).alias("problem")) for f in d.fields])
            checks = F.when(F.col("def") == d.name, own).otherwise(checks)
    rows = beings.select(*keys, "def", F.inline(F.filter(checks, lambda c: c["problem"].isNotNull())))
    return rows


def invalid_beings(beings: DataFrame) -> DataFrame:
    """id, problem of beings without a name or def."""
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    found = F.array_compact(F.array(F.when(empty("name"), F.lit("name")), F.when(empty("def"), F.lit("def"))))
    return beings.select("id", F.explode(found).alias("problem"))


def invalid_vectors(vectors: DataFrame, dims: dict[str, int] | None = None) -> DataFrame:
    """id, field, problem of vectors that are null or empty, or of another dimension than their field's."""
    size = F.size("vector")
    wrong = F.lit(False)
    for name, n in (dims or {}).items():
        wrong = wrong | ((F.col("field") == name) & (size != n))
    problem = F.when(F.col("vector").isNull() | (size == 0), F.lit("empty")).when(wrong, F.lit("dimension"))
    return vectors.select("id", "field", problem.alias("problem")).where("problem is not null")


def definitions_of(defs: DataFrame) -> list[Def]:
    """The (few) rows of a table of definitions as objects."""
    out = []
    for r in defs.select("name", "type_code", "fields").collect():
        fields = tuple(Field(f["name"], FieldType.parse(f["type"]), bool(f["required"]), f["default"], f["min"], f["max"]) for f in (r.fields or []) if f["name"] and f["type"])
        out.append(Def(r.name, fields, r.type_code))
    return out
