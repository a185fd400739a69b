"""One-permutation MinHash: packed fingerprints whose likeness estimates the resemblance of texts.

Every word shingle is hashed once. The hash's high bits name a bin, and a bin keeps its least
hash. An empty bin takes the value of another one by optimal densification: it draws bins at
random, by hashes of its own number and the draw's, until one isn't empty, so it borrows from
each filled bin alike and two texts draw alike. Where a few draws found none, the filled bin
with the least hash is taken, which has the same law and always ends. Of every bin the low
bits are kept, packed into 64-bit words; the share of equal bins is corrected for the bits
that agree by chance. A value is hashed with its bin before, so that the chances of a value that
many bins borrowed are independent. All of it is expressions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, ascii_lower, bare, packed, unpacked

#: Words of a shingle; bins and bits kept of each (both powers of two); draws before the least hash decides.
SHINGLE, BINS, BITS, DRAWS = 5, 256, 4, 8


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the text's word shingles, A-Z in lower case; fewer words are one shingle, none have none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({SPACED_WORD})"), F.lit(1))
    # xxhash64 passes over the nulls after the last word.
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
    return _bound(words, lambda w: F.when(F.size(w) > 0, hashes(w)).otherwise(F.array().cast("array<bigint>")))


def binned(hashes: Column, bins: int = BINS) -> Column:
    """The least hash of every bin, in the order of bins; null for an empty one."""
    shift = 64 - (bins.bit_length() - 1)
    low = (1 << shift) - 1
    # The largest value of each bin stands at its end, so that each bin has a first element.
    ends = F.lit([_signed((b << shift) | low) for b in range(bins)])
    bin_of = lambda x: F.shiftrightunsigned(x, shift)
    firsts = _bound(F.sort_array(F.concat(hashes, ends)), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    return F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(low)) != low, x))


def densified(values: Column, bins: int = BINS, draws: int = DRAWS) -> Column:
    """``values`` with empty bins filled from others; one bin at least must have a value."""
    drawn = lambda b, k: F.pmod(F.hash(b, F.lit(k)), F.lit(bins))
    least = lambda filled, b: F.array_min(F.transform(filled, lambda x: F.struct(F.hash(b, x).alias("by"), x.alias("x"))))["x"]
    both = F.struct(values.alias("v"), F.transform(values, lambda x, b: F.when(x.isNotNull(), b)).alias("b"))
    fill = lambda p, filled: F.transform(p["v"], lambda x, b: F.coalesce(x, *[F.get(p["v"], drawn(b, k)) for k in range(draws)], F.get(p["v"], least(filled, b))))
    return _bound(both, lambda p: _bound(F.array_compact(p["b"]), lambda filled: fill(p, filled)))


def low_bits(values: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The low bits of every value's hash with its bin, packed into words of 64."""
    each = 64 // bits
    mixed = F.transform(values, lambda x, b: F.xxhash64(x, b).bitwiseAND(F.lit((1 << bits) - 1)))
    word = lambda v, k: F.aggregate(F.sequence(F.lit(0), F.lit(each - 1)), F.lit(0).cast("bigint"), lambda acc, j: F.shiftleft(acc, bits).bitwiseOR(F.get(v, k * each + j)))
    return _bound(mixed, lambda v: F.transform(F.sequence(F.lit(0), F.lit(bins // each - 1)), lambda k: word(v, k)))


def fingerprint(text: Column, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed fingerprint, bins * bits / 64 words; an empty array for a text without words."""
    none = F.array().cast("array<bigint>")
    return _bound(shingle_hashes(text, shingle), lambda h: F.when(F.size(h) > 0, low_bits(densified(binned(h, bins), bins), bins, bits)).otherwise(none))


def likeness(one: Column, other: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated resemblance of the shingle sets, 0 to 1: two texts without words are alike, one of them is like no other."""
    ones = F.lit(_signed(sum(1 << k for k in range(0, 64, bits))))
    fold = lambda x: F.bit_count(_any_bit(x, bits).bitwiseAND(ones))
    apart = F.aggregate(F.zip_with(one, other, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + fold(x))
    chance = 1 / (1 << bits)
    corrected = F.greatest(F.lit(0.0), (1 - apart / bins - chance) / (1 - chance))
    return F.when(F.size(one) != F.size(other), 0.0).when(F.size(one) == 0, 1.0).otherwise(corrected)


def _any_bit(x: Column, bits: int) -> Column:
    """The lowest bit of each group of ``bits`` is set if any of the group is."""
    out = x
    for k in range(1, bits):
        out = out.bitwiseOR(F.shiftrightunsigned(x, k))
    return out


def as_hex(packed_words: Column) -> Column:
    return F.array_join(F.transform(packed_words, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def minhash(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` with ``fingerprint``.

    Equal texts have equal fingerprints, and so have texts that differ in A-Z's case or in
    white space alone. Null and empty texts and those of white space have an empty one.
    Rows are looked at one by one. A column called fingerprint gives way to the output.
    """
    made = docs.select(packed(docs), fingerprint(bare(text_col), shingle, bins, bits).alias("fp"))
    return unpacked(made, docs.columns, {"fingerprint": F.col("fp")})
