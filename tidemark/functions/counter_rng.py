"""Random numbers as a pure function of row keys.

The same keys give the same number on any partitioning, on any retry and in any engine, which is what makes
simulations repeatable after a lost executor and checkable. ``rand(seed)`` is neither.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

FINE_HEX = 13  # 52 bits, exact in a double
WORD_HEX = 8  # 32 bits

# The finaliser of the public-domain MurmurHash3 and the golden-ratio step that spreads small counters.
_MIX_1, _MIX_2, _GOLDEN, _MASK = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9, 0xFFFFFFFF


def _digest(*keys: Column) -> Column:
    return F.md5(F.concat_ws("#", *[k.cast("string") for k in keys]))


def _fine(digest: Column, start: int) -> Column:
    word = F.conv(F.substring(digest, start, FINE_HEX), 16, 10).cast("double")
    return (word + 0.5) / float(16**FINE_HEX)


def standard_normal(*keys: Column) -> Column:
    """Box-Muller on two 52-bit words of one md5."""
    digest = _digest(*keys)
    return F.sqrt(F.lit(-2.0) * F.ln(_fine(digest, 1))) * F.cos(F.lit(2.0 * math.pi) * _fine(digest, 1 + FINE_HEX))


def stream_key(*keys: Column) -> Column:
    """A 32-bit number naming a random stream, to be mixed with counters by ``uniforms``."""
    return F.conv(F.substring(_digest(*keys), 1, WORD_HEX), 16, 10).cast("bigint")


def _mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 32-bit numbers held in 64 bits, so that no product overflows."""
    h = h ^ (h >> np.uint64(16))
    h = (h * np.uint64(_MIX_1)) & np.uint64(_MASK)
    h = h ^ (h >> np.uint64(13))
    h = (h * np.uint64(_MIX_2)) & np.uint64(_MASK)
    return h ^ (h >> np.uint64(16))


def uniforms(key: int, scenarios: np.ndarray, step: int) -> np.ndarray:
    """One number strictly inside (0, 1) per scenario id (below 2^32), for one step of one stream."""
    of_scenario = _mix(np.uint64(key) ^ scenarios.astype(np.uint64))
    of_step = np.uint64((step + 1) * _GOLDEN & _MASK)
    return (_mix(of_scenario ^ of_step).astype(np.float64) + 0.5) / float(2**32)
