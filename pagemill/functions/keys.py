"""Keys: stable seeds, sample ids, path suffixes, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_seed(salt: str, key: Column) -> Column:
    """A fixed number in [0, 2^60): the first 15 hex digits of the SHA-1 of ``salt:key``."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(salt), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def encode_key(key: Column, crop: Column | None = None) -> Column:
    """``a/b/c`` with crop 1 becomes ``a__b__c--c1``."""
    flat = F.replace(key, F.lit("/"), F.lit("__"))
    return flat if crop is None else F.concat(flat, F.lit("--c"), crop.cast("string"))


def decode_key(sample_id: Column) -> Column:
    return F.replace(F.regexp_replace(sample_id, r"--c\d+$", ""), F.lit("__"), F.lit("/"))


def covers(path: Column, suffix: Column) -> Column:
    """Whether ``path`` ends with the whole components of ``suffix``."""
    p, s = (F.split(F.trim(x, F.lit("/")), "/") for x in (path, suffix))
    return (F.size(p) >= F.size(s)) & (F.slice(p, F.greatest(F.size(p) - F.size(s) + 1, F.lit(1)), F.size(s)) == s)


def safe_name(label: Column) -> Column:
    return F.trim(F.regexp_replace(label, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
