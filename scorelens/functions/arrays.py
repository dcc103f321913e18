"""Array expressions for labelled arrays (images, embeddings, logits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def channel_to_pixel_major(arr, channels: int) -> Column:
    """Channel-major (c, h, w) flattened -> pixel-major (h, w, c), values as double.

    Output element i is input element ``(i % c) * hw + i div c`` (0-based).
    """
    a = _c(arr)
    hw = F.size(a) / F.lit(channels)
    idx = F.sequence(F.lit(0), F.size(a) - 1)
    return F.transform(
        idx,
        lambda i: F.element_at(
            a, ((i % channels) * hw.cast("int") + F.floor(i / channels).cast("int") + 1)
        ).cast("double"),
    )


def argmax(arr) -> Column:
    """0-based position of the largest element; the first wins on ties."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def wrap_uint8(arr) -> Column:
    """Cast every element to 8 bits the way an unsigned byte cast does: modulo 256."""
    return F.transform(_c(arr), lambda x: F.pmod(x.cast("int"), F.lit(256)))
