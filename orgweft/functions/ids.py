"""Stable ids. blake2b is not a Spark function, so these two are Arrow batch functions."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType

MAX_ID = 2**63 - 1
# Personalisation of the id hash. A deployment that must keep the ids of an older
# installation passes that installation's value instead.
DEFAULT_PERSON = b"orgweft-id"


def stable_id(
    dataset_id: str | Column,
    label: str | Column,
    key: Column,
    *,
    person: bytes = DEFAULT_PERSON,
) -> Column:
    """Positive 63-bit id of ``dataset|label|key``."""

    @arrow_udf(LongType())
    def hashed(payload: pa.Array) -> pa.Array:
        out = []
        for text in payload.to_pylist():
            if text is None:
                out.append(None)
                continue
            digest = hashlib.blake2b(text.encode(), digest_size=8, person=person).digest()
            out.append((int.from_bytes(digest, "big") & MAX_ID) or 1)
        return pa.array(out, pa.int64())

    dataset = F.lit(dataset_id) if isinstance(dataset_id, str) else dataset_id
    label_column = F.lit(label) if isinstance(label, str) else label
    return hashed(F.concat(dataset, F.lit("|"), label_column, F.lit("|"), key))


@arrow_udf(StringType())
def short_digest(value: pa.Array) -> pa.Array:
    """Eight hex digits of the 4-byte blake2b digest."""
    return pa.array(
        [
            None if text is None else hashlib.blake2b(text.encode(), digest_size=4).hexdigest()
            for text in value.to_pylist()
        ],
        pa.string(),
    )


def path_key(label: Column | str, node_id: Column) -> Column:
    label_column = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lower(label_column), F.lit(":"), F.lpad(node_id.cast("string"), 20, "0"))


def edge_id_payload(source_id: Column, target_id: Column, discriminator: Column) -> Column:
    return F.concat_ws("|", source_id.cast("string"), target_id.cast("string"), discriminator)
