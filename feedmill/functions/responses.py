"""Reading a scorer's answer: strict JSON between the first and the last brace [X17].

Spark's JSON functions accept trailing text and reject duplicate keys, the opposite of what is
wanted here, so the strict reading is a small Arrow-batched function.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

PARSED = T.StructType(
    [T.StructField("summary", T.StringType()), T.StructField("key_points", T.ArrayType(T.StringType()))]
)


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_response(answer: str) -> tuple[str | None, list[str | None] | None]:
    """(summary, key points) of one answer; text that holds no JSON object is itself the summary."""
    plain = answer.strip()
    opening, closing = answer.find("{"), answer.rfind("}")
    if opening < 0:
        return plain, []
    try:
        found = json.loads(answer[opening : closing + 1])
    except json.JSONDecodeError:
        return plain, []
    points = found.get("key_points", [])
    if points is not None and not isinstance(points, list):
        points = [points]
    return (
        _as_text(found["summary"]) if "summary" in found else plain,
        None if points is None else [_as_text(p) for p in points],
    )


@F.pandas_udf(PARSED)
def _read_responses(answers: pd.Series) -> pd.DataFrame:
    read = [(None, None) if a is None else read_response(a) for a in answers]
    return pd.DataFrame(read, columns=["summary", "key_points"])


def parse_response(answer: Column) -> Column:
    """struct(summary, key_points); both NULL when the call gave no answer."""
    return _read_responses(answer)
