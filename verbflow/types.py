"""Kinds of types and how they combine: logical < integer < double; text only with text."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import ExprError

_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4}


def kind(dtype: T.DataType) -> str:
    match dtype:
        case T.NullType():
            return "unspecified"
        case T.BooleanType():
            return "logical"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "integer"
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return "double"
        case T.StringType():
            return "character"
        case T.DateType():
            return "date"
        case T.TimestampType() | T.TimestampNTZType():
            return "datetime"
        case T.DayTimeIntervalType():
            return "duration"
        case T.ArrayType():
            return "list"
        case T.StructType():
            return "struct"
    return dtype.simpleString()


def common_type(a: T.DataType, b: T.DataType, a_name: str = "x", b_name: str = "y") -> T.DataType:
    """The type that holds both without loss of meaning, or an error that names the two."""
    if a == b:
        return a
    ka, kb = kind(a), kind(b)
    if ka == "unspecified":
        return b
    if kb == "unspecified":
        return a
    rank = {"logical": 0, "integer": 1, "double": 2}
    if ka in rank and kb in rank:
        if ka == kb == "integer":
            return max(a, b, key=lambda t: _WIDTH[type(t)])
        if ka == kb == "double":
            return T.DoubleType()
        return a if rank[ka] > rank[kb] else b
    if ka == kb == "character":
        return T.StringType()
    raise ExprError(f"Can't combine `{a_name}` <{ka}> and `{b_name}` <{kb}>.")


def common_of(dtypes: list[T.DataType], names: list[str]) -> T.DataType:
    out, who = dtypes[0], names[0]
    for t, name in zip(dtypes[1:], names[1:], strict=True):
        before = out
        out = common_type(out, t, who, name)
        who = who if out == before else name
    return out


def is_numeric_type(dtype: T.DataType) -> bool:
    return kind(dtype) in ("integer", "double")


def _field_type(field) -> T.DataType:
    return field.dataType if isinstance(field, T.StructField) else field


def is_numeric(field) -> bool:
    """For ``where()``: integer or double columns.  Predicates get a StructField."""
    return is_numeric_type(_field_type(field))


def is_integer(field) -> bool:
    return kind(_field_type(field)) == "integer"


def is_double(field) -> bool:
    return kind(_field_type(field)) == "double"


def is_character(field) -> bool:
    return kind(_field_type(field)) == "character"


def is_logical(field) -> bool:
    return kind(_field_type(field)) == "logical"
