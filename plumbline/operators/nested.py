"""Fields of structs as columns of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from plumbline.operators.columns import cells


def leaves(df: DataFrame) -> DataFrame:
    """``df`` with every struct replaced by its fields, at any depth, under dotted names.

    Arrays and maps hold any number of values in a cell, so they stay as they are; type
    inference calls them ``unknown``.  A leaf whose dotted name another column has already
    gets an underscore more.
    """
    if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    taken: set[str] = {f.name.lower() for f in df.schema.fields if not isinstance(f.dataType, T.StructType)}
    out: list[Column] = []

    def walk(at: Column, name: str, kind: T.DataType, top: bool) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(at.getField(f.name), f"{name}.{f.name}", f.dataType, False)
            return
        if not top:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out.append(at.alias(name))

    for c in cells(df):
        walk(c.raw, c.name, c.dtype, True)
    return df.select(*out)
