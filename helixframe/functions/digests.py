"""Canonical JSON of nested values, and digests of it: the same text for the same value, whatever order its fields have.

The expression follows from the schema: keys ascend by code point at every level, no space stands between tokens, numbers
have one form each, and a digest of a record is that of its canonical text in UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits after the point that a fraction may have.
SCALE = 9


def _quoted(x: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all others as they are."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(name))
    rare = [chr(c) for c in range(32) if chr(c) not in "\b\f\n\r\t"]
    for char in rare:
        out = F.replace(out, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _number(x: Column) -> Column:
    """A fraction without exponent: at most ``SCALE`` digits after the point, no zeros at the end; whole numbers bare."""
    text = x.cast(f"decimal(38,{SCALE})").cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def canonical_json(x: Column, kind: T.DataType) -> Column:
    """``x`` as canonical JSON text; null is ``null``."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(("," if k else "") + _key(f.name)), canonical_json(x[f.name], f.dataType)) for k, f in enumerate(fields)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: canonical_json(y, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(x), _by_key), entry), ","), F.lit("}"))
    elif isinstance(kind, T.IntegralType | T.BooleanType):
        text = x.cast("string")
    elif isinstance(kind, T.FractionalType):
        text = _number(x)
    elif isinstance(kind, T.BinaryType):
        text = _quoted(F.base64(x))
    else:
        text = _quoted(x.cast("string"))
    return F.when(x.isNull(), null).otherwise(text)


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def _key(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False) + ":"


def record_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The canonical text of a row's ``columns`` (all, unless given)."""
    names = columns or df.columns
    kind = T.StructType([df.schema[c] for c in names])
    return canonical_json(F.struct(*names), kind)


def record_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha2(F.encode(record_json(df, columns), "UTF-8"), 256)


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest) of a table whatever the order of its rows: sums of the quarters of its rows' digests, hashed.

    Equal rows count each; the sums are taken modulo 2^64 by partial aggregation, so nothing is sorted or collected.
    """
    h = record_digest(df, columns)
    quarter = [F.conv(F.substring(h, 16 * k + 1, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(q), F.lit(0)).cast("decimal(38,0)").alias(f"_q{k}") for k, q in enumerate(quarter)))
    said = F.concat_ws(",", F.col("rows").cast("string"), *(F.col(f"_q{k}").cast("string") for k in range(4)))
    return sums.select("rows", F.sha2(said.cast("binary"), 256).alias("digest"))
