"""Scalar functions on vectors and signatures, as Spark expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of one signature word: held in a bigint, so no sign bit is touched.
WORD_BITS = 32


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def is_valid(vector: Column, dim: int | None = None) -> Column:
    """Not null or empty, all components finite, not all zero, and dim long if dim is given."""
    length = F.size(vector) == dim if dim else F.size(vector) > 0
    return F.coalesce(length & F.forall(vector, is_finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double; null if either is null. Vectors of unequal length give null, as the shorter is padded with nulls."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def cosine_score(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2, rounded to 6 decimals."""
    return F.round((1 + cosine(a, b)) / 2, 6)


def dot_score(a: Column, b: Column) -> Column:
    """(1 + scalar product) / 2, rounded to 6 decimals."""
    return F.round((1 + dot(a, b)) / 2, 6)


def euclidean_score(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance), rounded to 6 decimals."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.round(1 / (1 + squares), 6)


def l2_normalize(a: Column) -> Column:
    """array<double> of length 1; null for a zero vector."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def signature_words(vector: Column) -> Column:
    """array<bigint>: bit i % 32 of word i div 32 is 1 if component i >= 0. NaN and null give 0, -0.0 gives 1; the tail is padded with 0."""
    bit = lambda i: F.when(F.coalesce((F.get(vector, i) >= 0) & ~F.isnan(F.get(vector, i)), F.lit(False)), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    count = F.ceil(F.size(vector) / WORD_BITS).cast("int")
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), F.lit(0).cast("bigint"), lambda s, i: s + bit(w * WORD_BITS + i) * F.pow(F.lit(2.0), i).cast("bigint"))
    return F.when(F.size(vector) > 0, F.transform(F.sequence(F.lit(0), count - 1), word))


def words_of_bytes(signature: Column) -> Column:
    """array<bigint> of a binary signature whose length is a multiple of 4, bytes in order of their bits; null otherwise."""
    one = lambda i: F.conv(F.hex(F.substring(signature, i + 1, F.lit(1))), 16, 10).cast("bigint")
    word = lambda w: one(w * 4) + one(w * 4 + 1) * 256 + one(w * 4 + 2) * 65_536 + one(w * 4 + 3) * 16_777_216
    length = F.octet_length(signature)
    return F.when((length > 0) & (length % 4 == 0), F.transform(F.sequence(F.lit(0), (length / 4).cast("int") - 1), word))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays; null if either is null or their lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def is_near(a: Column, b: Column, most: int) -> Column:
    """At most `most` bits differ."""
    return hamming(a, b) <= most


def global_id(shard: Column, local: Column) -> Column:
    return F.shiftleft(shard.cast("bigint"), 32).bitwiseOR(local.cast("bigint"))


def shard_of(id_: Column) -> Column:
    return F.shiftright(id_, 32).cast("int")


def local_of(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def signs_of_bytes(signature: Column, bits: int) -> Column:
    """array<double> of 1 and -1 for the bits of a binary signature, bit i at byte i >> 3, place i & 7; null unless it has exactly these bits."""
    byte = lambda i: F.conv(F.hex(F.substring(signature, F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    sign = lambda i: F.when(F.shiftright(byte(F.lit(i)), i % 8).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return F.when(F.octet_length(signature) * 8 == bits, F.array(*[sign(i) for i in range(bits)]))
