"""Hashes and ids as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def canonical_json(entries: Column) -> Column:
    """a map as compact JSON with sorted keys; null values stay."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))), {"ignoreNullFields": "false"})


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """the version-5 UUID of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80)))), 1, 2)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12))
