"""Column expressions that several operators share. All stay inside code generation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def nan_div(a: Column, b: Column) -> Column:
    """a / b, NaN where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(NAN))


def floordiv(a: Column, b: Column) -> Column:
    """Floor division as arrays have it: by the remainder, which is not always the floor of the quotient (1.0 // 0.1 is 9)."""
    return F.round(F.try_divide(a - F.try_mod(a, b), b))


def hash_key(seed: int | str, *ids: Column) -> Column:
    """A reproducible random order: the MD5 of seed and ids, which any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids]).cast("binary"))


def plain_hash_key(seed: int | str, *ids: int | str | None) -> str:
    """``hash_key`` of plain values; nulls are passed over there as here."""
    return hashlib.md5(":".join(map(str, (seed, *(i for i in ids if i is not None)))).encode()).hexdigest()


def bucket(seed: int | str, n: Column | int, *ids: Column) -> Column:
    """A reproducible uniform number in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(hash_key(seed, *ids), 1, 8), 16, 10).cast("long"), n.cast("long"))
