"""Bitmaps of 64-bit keys: a bounded broadcast that keeps what is in no table out of the shuffles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _STEP, mix

#: Bits of a part, the unit in which a bitmap reaches the driver.
PART = 20
#: At most 2^30 bits, 128 MB: beyond the keys for which that suffices a bitmap passes more that a join then drops.
MOST = 30


def size_for(keys: int, bits_a_key: int = 32, least: int = PART) -> int:
    """log2 of the bits for so many keys."""
    return min(MOST, max(least, math.ceil(math.log2(max(1, keys * bits_a_key)))))


def slots(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The bit of each key (uint64) for one probe."""
    return mix(keys * _STEP[48 + probe] + np.uint64(probe)) >> np.uint64(64 - bits)


def packed(placed: DataFrame, size: int) -> np.ndarray:
    """Bytes of a bitmap of `size` bits, set at every slot (long, below size); each part is put together in its own group."""

    def pack(part: pa.Table) -> pa.Table:
        out = np.zeros(1 << PART, bool)
        own = part["slot"].to_numpy()
        out[own & ((1 << PART) - 1)] = True
        return pa.table({"part": pa.array([own[0] >> PART], pa.int64()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((-(-size // (1 << PART)), 1 << (PART - 3)), np.uint8)
    parts = placed.select("slot").distinct().withColumn("part", F.shiftright("slot", PART)).groupBy("part").applyInArrow(pack, "part long, bits binary")
    for r in parts.toLocalIterator():  # a row for every 128 KB
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def bitmap(keys: DataFrame, bits: int, probes: int = 4) -> np.ndarray:
    """2^bits bits, `probes` of them set for every key of the only column (long)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([slots(own, bits, i) for i in range(probes)])).view(np.int64))], ["slot"])

    return packed(keys.mapInArrow(place, "slot long"), 1 << bits)


def may_be(bits: np.ndarray, keys: np.ndarray, probes: int = 4) -> np.ndarray:
    """False where a key is surely not among those of the bitmap."""
    log2 = int(len(bits)).bit_length() + 2
    left = np.arange(len(keys))
    for i in range(probes):
        slot = slots(keys[left], log2, i)
        left = left[(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out
