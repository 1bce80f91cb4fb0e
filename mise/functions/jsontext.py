"""JSON text of typed columns: indented by four, in ASCII, unset fields left out.

The writer follows the column's schema: objects are their set fields, strings are
escaped by Python's own encoder, which an Arrow UDF asks for each of them.  As an expression over
the row every character beyond ASCII is a step of its own, some ten times the cost.
"""

from __future__ import annotations

from json.encoder import encode_basestring_ascii as quoted

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDENT = 4
# Rows of a batch that are Python objects at a time.
ROWS_AT_A_TIME = 256


def _nested(parts: list[str], level: int, brackets: str) -> str:
    if not parts:
        return brackets
    pad, outer = "\n" + " " * (INDENT * (level + 1)), "\n" + " " * (INDENT * level)
    return brackets[0] + pad + ("," + pad).join(parts) + outer + brackets[1]


def _texts(column: pa.Array, kind: T.DataType, level: int) -> list[str | None]:
    """Indented JSON texts of a column's values, None for NULL; column by column, as values of nested types are dear one by one."""
    if isinstance(kind, T.StringType):
        return [None if v is None else quoted(v) for v in column.to_numpy(zero_copy_only=False).tolist()]
    if isinstance(kind, T.BooleanType):
        return [None if v is None else "true" if v else "false" for v in column.to_pylist()]
    if isinstance(kind, T.StructType):
        heads = [quoted(f.name) + ": " for f in kind.fields]
        fields = [_texts(column.field(i), f.dataType, level + 1) for i, f in enumerate(kind.fields)]
        rows = zip(*fields) if fields else [()] * len(column)
        return [_nested([head + text for head, text in zip(heads, row) if text is not None], level, "{}") if held else None
                for held, row in zip(column.is_valid().to_pylist(), rows)]
    if isinstance(kind, T.ArrayType):
        ends = column.offsets.to_pylist()
        items = ["null" if text is None else text for text in _texts(column.values[ends[0]:ends[-1]], kind.elementType, level + 1)]
        return [_nested(items[start - ends[0]:end - ends[0]], level, "[]") if held else None
                for held, start, end in zip(column.is_valid().to_pylist(), ends, ends[1:])]
    return [None if v is None else str(v) for v in column.to_pylist()]


def _check(kind: T.DataType) -> None:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            _check(f.dataType)
    elif isinstance(kind, T.ArrayType):
        _check(kind.elementType)
    elif not isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"no JSON text for {kind.simpleString()}")


def pretty_json(name: str, kind: T.DataType) -> Column:
    """Indented JSON text of a named column."""
    _check(kind)

    def texts(column: pa.Array) -> pa.Array:
        parts = [pa.array(["null" if t is None else t for t in _texts(column.slice(at, ROWS_AT_A_TIME), kind, 0)], pa.string())
                 for at in range(0, len(column), ROWS_AT_A_TIME)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    texts.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(texts, T.StringType())(F.col(f"`{name}`"))
