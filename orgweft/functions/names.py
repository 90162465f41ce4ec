"""Name decoding that needs the Python standard library, as Arrow batch functions."""

from __future__ import annotations

import unicodedata
from email.header import decode_header, make_header

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


def _decode(value: str) -> str:
    if "=?" not in value:
        return value
    try:
        return str(make_header(decode_header(value)))
    except Exception:  # a malformed header keeps its raw text
        return value


@arrow_udf(StringType())
def decode_words(values: pa.Array) -> pa.Array:
    """Mail header words (``=?utf-8?...?=``) as plain text."""
    return pa.array([None if v is None else _decode(v) for v in values.to_pylist()], pa.string())


@arrow_udf(StringType())
def fold_accents(values: pa.Array) -> pa.Array:
    """Decoded text with accents removed and other non-ASCII characters dropped."""
    out = []
    for value in values.to_pylist():
        if value is not None:
            folded = unicodedata.normalize("NFKD", _decode(value))
            value = folded.encode("ascii", "ignore").decode("ascii")
        out.append(value)
    return pa.array(out, pa.string())
