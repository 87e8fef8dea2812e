"""Global counts of 64-bit keys that come back to where the keys are.

Documents are dealt out in batches of bounded size. A batch sends each distinct key once, sorted and packed, to the bucket
that the key's top bits name; a bucket merges what all batches sent and answers each batch with one value per key, in the
order sent. So a key that every document holds costs a bucket one entry per batch, and neither side ships key and
document together. Batches and buckets are sized from the input, so both stay small at any scale.

What a batch sends to one bucket holds about batch keys * bucket keys / all keys. Buckets grow with the input, up to a limit, to
keep that above a few dozen; for inputs of many terabytes raise the batches' characters as executor memory allows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_PER_BUCKET, MOST_KEYS_PER_BUCKET = 500_000, 16_000_000
LEAST_KEYS_SENT = 64
SENT = "bucket long, batch long, keys binary, extra binary"
ANSWER = "batch long, bucket long, kind int, payload binary"


def released(table: pa.Table) -> pa.Table:
    """The result of a group; what its work has left in Arrow's pool goes back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    return table


def total_chars(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0


def batches_for(chars: int, batch_chars: int) -> int:
    return max(1, math.ceil(chars / batch_chars))


def bucket_bits(keys: int, batches: int) -> int:
    """Bits of the bucket number for so many keys out of so many batches."""
    size = min(MOST_KEYS_PER_BUCKET, max(KEYS_PER_BUCKET, LEAST_KEYS_SENT * batches))
    return max(0, math.ceil(math.log2(max(1, keys / size))))


def encode(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in byte planes; the upper planes are nearly all zero and compress away."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def decode(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def planes32(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes32(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def slices(keys: np.ndarray, bits: int):
    """Of sorted keys: each bucket that has some, with its bounds."""
    if not len(keys):
        return
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for begin, end in zip(begins, np.r_[begins[1:], len(keys)]):
        yield int(bucket[begin]), int(begin), int(end)


def gather(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a bucket, where each blob begins, and the order that sorts the keys (ties: earlier blob first)."""
    parts = [decode(b) for b in blobs]
    bounds = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return keys, bounds, np.argsort(keys, kind="stable")


def group_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the number of the distinct key at each place, and where each distinct key begins."""
    new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]] if len(sorted_keys) else np.zeros(0, bool)
    return np.cumsum(new) - 1, np.flatnonzero(new)
