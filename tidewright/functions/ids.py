"""Content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespaces of RFC 4122.
OID, URL = "6ba7b812-9dad-11d1-80b4-00c04fd430c8", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(namespace: Column | str, name: Column) -> Column:
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    h = F.sha1(F.concat(F.unhex(F.regexp_replace(space, "-", "")), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON; equal for equal content in this engine only."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def camera_id(index: Column, url: Column) -> Column:
    return F.concat(F.lit("camera-"), index.cast("string"), F.lit("-"), F.substring(uuid5(URL, url), 1, 8))


def safe_component(c: Column) -> Column:
    clean = F.substring(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), 1, 80)
    return F.when(clean == "", "camera").otherwise(clean)


def redacted_url(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\w+)://.*", "$1://***")
