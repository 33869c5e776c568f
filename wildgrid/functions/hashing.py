"""Seeded, repeatable pseudo-random keys.

The key depends only on the seed and the row's own id, so that a lost task, a
new partitioning or another engine gives the same order. ``rand`` does not.
"""

from pyspark.sql import functions as F

from .text import _col


def hash_key(ids, seed):
    """md5 of seed and ids: 32 hexadecimal digits in uniform order."""
    ids = [ids] if not isinstance(ids, (list, tuple)) else ids
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in ids]))


def hash_number(ids, seed, digits=8):
    """The first digits of the key as a whole number below 16^digits."""
    return F.conv(F.substring(hash_key(ids, seed), 1, digits), 16, 10).cast("long")


def hash_unit(ids, seed):
    """A repeatable number in [0, 1)."""
    return hash_number(ids, seed, 12) / F.lit(float(16 ** 12))
