"""Arrow string columns seen as flat byte arrays, for work on whole batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: True for the bytes of white space between words, `[\x20\x09-\x0D]`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 offsets between them. Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word `[^\x20\x09-\x0D]+`, and the n + 1 offsets of the texts' words in these."""
    word = ~IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = word[first]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of words `[^\x20\x09-\x0D]+`; null has none."""
    data, offsets = flat(texts)
    return pa.array(np.diff(word_bounds(data, offsets)[2]))
