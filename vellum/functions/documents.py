"""Functions over JSON documents in string columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F


def json_typeof(document: Column, path: str = "$") -> Column:
    """object, array, string, number, boolean or null: the type of what a path leads to; null where it leads nowhere, or the document is null or no JSON."""
    value = F.try_parse_json(document)
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def json_set(document: Column, key: str, value: Column) -> Column:
    """The document, an object, with value, a JSON text, under a key of its top level; others stay in their order. Null, and what is no object, gives null; so does a value that is no JSON."""

    def one(text: str | None, new: str | None) -> str | None:
        try:
            held, put = json.loads(text), json.loads(new)
        except (TypeError, ValueError):
            return None
        return json.dumps(held | {key: put}, separators=(",", ":"), ensure_ascii=False) if isinstance(held, dict) else None

    def run(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(document, value)
