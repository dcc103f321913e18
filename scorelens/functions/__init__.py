"""Column-level functions: pure JVM expressions, safe inside whole-stage codegen."""

from scorelens.functions.arrays import argmax, channel_to_pixel_major, wrap_uint8
from scorelens.functions.hashing import md5_bucket, md5_int
from scorelens.functions.text import (
    inner_path, path_part, tokens_mask, tokens_pad_truncate, with_unit, words,
)
from scorelens.functions.times import epoch_seconds, epoch_to_timestamp, placeholder_zero

__all__ = [
    "argmax", "channel_to_pixel_major", "wrap_uint8", "md5_bucket", "md5_int",
    "inner_path", "path_part", "tokens_mask", "tokens_pad_truncate", "with_unit", "words",
    "epoch_seconds", "epoch_to_timestamp", "placeholder_zero",
]
