"""Deterministic identities and hashed vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def sha_id(length: int, *parts: Column | str) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by colons."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.left(F.sha2(F.concat_ws(":", *cols), 256), F.lit(length))


def doc_id(name: Column, content: Column) -> Column:
    return F.left(F.sha2(F.concat(F.encode(name, "utf-8"), content), 256), F.lit(16))


def chunk_id(doc: Column, first: Column, last: Column, kind: Column, index: Column) -> Column:
    return sha_id(20, doc, first, last, kind, index)


def node_id(label: Column) -> Column:
    return sha_id(24, F.lower(F.trim(label)))


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hash_slot(token: Column, dim: int = 384) -> Column:
    """SHA-256 of the token, as a number, modulo dim."""
    h = F.sha2(token, 256)
    return F.aggregate(F.sequence(F.lit(1), F.lit(57), F.lit(8)), F.lit(0).cast("long"), lambda a, i: (a * F.lit(4294967296) + F.conv(F.substring(h, i, F.lit(8)), 16, 10).cast("long")) % F.lit(dim))


def image_vector(content: Column, dim: int = 32) -> Column:
    """The digest's bytes summed by place modulo dim, to length 1."""
    h = F.sha2(content, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i % dim == d), F.lit(0.0), lambda a, i: a + F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double")))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors, 0 where either is all zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
