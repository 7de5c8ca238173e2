"""Column helpers."""

from .columns import bucket, floordiv, hash_key, nan_div, plain_hash_key

__all__ = ["bucket", "floordiv", "hash_key", "nan_div", "plain_hash_key"]
