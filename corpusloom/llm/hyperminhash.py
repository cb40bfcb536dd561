"""HyperMinHash sketches of shingle sets.

A register holds, for one bucket, the least hash as its count of leading zeros
(6 bits) and MANTISSA bits after the first one.  Small sets fill few buckets,
so a sketch has two zones:

* zone S, for sets of at most SMALL shingles: bucket j is the whole set under
  the j-th permutation (multiplication by an odd constant modulo 2**64);
* zone L, for sets of at least SMALL * 0.75 shingles: one permutation, the
  first bits of a hash name its bucket; buckets may be empty, on both sides.

Two sets with a similarity of 0.75 have sizes within that ratio, so that they
share a zone.  Bands are cut from REGISTERS registers.  Estimates rest on FINE
registers, stored in 4 bits each: 0 for an empty one, else one more than the
zeros modulo WRAP (minima of sets of like size lie within a few zeros of each
other) and the first mantissa bit.  For the same bytes that errs half as much
as whole registers do.  The share of equal registers is corrected by the
chance that different minima agree in what is stored.
"""

from __future__ import annotations

import numpy as np
import xxhash

REGISTERS = 128
ROWS = 4  # registers in a band: 32 bands
MANTISSA = 10
SMALL = 256
LARGE = int(0.75 * SMALL)
FINE = 1024
BANDS = REGISTERS // ROWS
SKETCH_BYTES = FINE // 2 + 4 * BANDS
EMPTY = np.uint16(0xFFFF)
# Odd multipliers of the permutations: a fixed pseudo-random sequence.
_ODD = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = np.random.Generator(np.random.PCG64(77003)).integers(0, 1 << 63, 2 * (REGISTERS // ROWS), dtype=np.uint64)
WRAP = 7
STORED_BITS = 1  # of the mantissa


def collision_chance(similarity: float, bits: int = STORED_BITS) -> float:
    """Chance that the minima of two equally large sets agree in what is stored, given that they differ.

    The least of the union is x, of one set alone; the other set's minimum
    lies behind it by an exponential distance.  Averaged over x and over the
    position of the sets' size between two powers of two.
    """
    other = (1 + similarity) / 2  # share of the union that the other set has
    x = (np.arange(4000) + 0.5) / 4000 * 16
    found = []
    for size in 2.0 ** (np.arange(16) / 16):
        scaled = x / size  # in units in which cells are bounded by powers of two
        cell = 2.0 ** np.floor(np.log2(scaled)) / (1 << bits)
        end = (np.floor(scaled / cell) + 1) * cell
        within = 1 - np.exp(-(end - scaled) * size * other)
        # The same cell after WRAP halvings of the hash space, above x.
        low, width = np.floor(scaled / cell) * cell * 2.0**WRAP, cell * 2.0**WRAP
        again = np.exp(-(low - scaled) * size * other) - np.exp(-(low + width - scaled) * size * other)
        found.append(np.average(within + again, weights=np.exp(-x)))
    return float(np.mean(found))


COLLISION = collision_chance(0.75)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Distinct hashes (sorted uint64) of the runs of `width` words; fewer words are one run."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = xxhash.xxh3_64_intdigest
    if len(words) <= width:
        return np.array([hashed(b" ".join(words))], dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter(map(hashed, runs), dtype=np.uint64, count=len(words) - width + 1))


def _registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of minima."""
    # frexp on a double loses low bits that the mantissa does not keep, but may round up.
    exponent = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    over = (exponent > 0) & (exponent < 65) & ((least >> np.minimum(np.maximum(exponent - 1, 0), 63).astype(np.uint64)) == 0)
    exponent = np.minimum(exponent - over, 64)
    zeros = 64 - exponent
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    tail = (least >> shift) & np.uint64((1 << MANTISSA) - 1)
    return (np.minimum(zeros, 62).astype(np.uint16) << np.uint16(MANTISSA)) | tail.astype(np.uint16)


def sketch_small(s: np.ndarray) -> np.ndarray:
    """FINE registers; bands use the first ones."""
    least = np.full(FINE, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(s), 32):
        np.minimum(least, (s[k : k + 32, None] * _ODD[None, :]).min(axis=0), out=least)
    return _registers(least)


def sketch_large(s: np.ndarray, buckets: int) -> np.ndarray:
    bits = np.uint64(buckets.bit_length() - 1)
    bounds = np.arange(buckets, dtype=np.uint64) << (np.uint64(64) - bits)
    first = np.searchsorted(s, bounds)
    end = np.append(first[1:], len(s))
    least = s[np.minimum(first, len(s) - 1)] << bits
    return np.where(end > first, _registers(least), EMPTY)


def bands(registers: np.ndarray, zone: int) -> np.ndarray:
    """A key of each band of ROWS registers (int64)."""
    rows = registers.reshape(-1, ROWS).astype(np.uint64)
    packed = np.zeros(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        packed = packed << np.uint64(16) | rows[:, k]
    seed = _BAND_SEEDS[zone * len(rows) : (zone + 1) * len(rows)]
    x = (packed ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53) + seed
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _sketch(fine: np.ndarray, keys: np.ndarray) -> bytes:
    """FINE registers of 4 bits, then 32 bits of each band key."""
    zeros, first = fine >> MANTISSA, fine >> (MANTISSA - STORED_BITS) & ((1 << STORED_BITS) - 1)
    stored = np.where(fine == EMPTY, 0, 1 + (zeros % WRAP << STORED_BITS | first)).astype(np.uint8)
    return (stored[0::2] | stored[1::2] << 4).tobytes() + (keys & 0xFFFFFFFF).astype("<u4").tobytes()


def sketches(s: np.ndarray) -> tuple[bytes | None, bytes | None, np.ndarray, np.ndarray]:
    """Sketches of zone S and L (None where a set is not in it) and the band keys of each."""
    none = np.zeros(0, np.int64)
    small, large, small_keys, large_keys = None, None, none, none
    if 0 < len(s) <= SMALL:
        fine = sketch_small(s)
        small_keys = bands(fine[:REGISTERS], 0)
        small = _sketch(fine, small_keys)
    if len(s) >= LARGE:
        large_keys = bands(sketch_large(s, REGISTERS), 1)
        large = _sketch(sketch_large(s, FINE), large_keys)
    return small, large, small_keys, large_keys


def unpack(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Registers (rows x FINE) and band fingerprints (rows x BANDS) of sketches."""
    raw = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, SKETCH_BYTES)
    packed = raw[:, : FINE // 2]
    registers = np.empty((len(raw), FINE), dtype=np.uint8)
    registers[:, 0::2], registers[:, 1::2] = packed & 15, packed >> 4
    return registers, np.ascontiguousarray(raw[:, FINE // 2 :]).view("<u4")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of register rows, and how many registers it rests on.

    Registers that one set alone fills differ for certain: only those that
    both fill can agree by collision.
    """
    used = np.maximum(np.count_nonzero(a | b, axis=-1), 1)
    both = np.minimum(a, b) != 0
    equal = np.count_nonzero((a == b) & both, axis=-1)
    return (equal - COLLISION * np.count_nonzero(both, axis=-1)) / (used * (1 - COLLISION)), used


def plausible(a: np.ndarray, b: np.ndarray, least: float, sigmas: float = 4.5) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and whether a true similarity of `least` can't be ruled out."""
    j, used = estimate(a, b)
    p = least + (1 - least) * COLLISION
    return j, j >= least - sigmas * np.sqrt(p * (1 - p) / used) / (1 - COLLISION)
