"""The 32-bit checksum of a logged write."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW = 4294967295


def _fold(a: Column, b: Column) -> Column:
    return (a * 31 + b).bitwiseAND(F.lit(LOW))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _string_hash(s: Column) -> Column:
    """Sum of UTF-16 units times powers of 31, mod 2^32."""
    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("...."), F.lit(0))
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda a, u: _fold(a, F.conv(u, 16, 10).cast("bigint")))


def _long_hash(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(LOW))


def double_bits(value: Column) -> Column:
    """IEEE-754 bits of a double as a bigint, NaN in its canonical form.

    Spark has no built-in for this. It is built from the exponent and the mantissa, all exact
    in doubles: every step is a division by a power of two.
    """
    shift = lambda a, e: a / F.pow(F.lit(2.0), F.floor(e / 2)) / F.pow(F.lit(2.0), e - F.floor(e / 2))  # noqa: E731  in two steps, so that 2^e stays finite
    scaled = lambda a, e: F.struct(e.alias("e"), shift(a, e).alias("m"))
    # log2 can be off by one next to a power of two.
    fixed = lambda a, x: F.when(x["m"] >= 2, scaled(a, x["e"] + 1)).when((x["m"] < 1) & (x["e"] > -1022), scaled(a, x["e"] - 1)).otherwise(x)
    whole = lambda m: (m * 4503599627370496.0).cast("bigint")
    packed = lambda x: F.when(x["m"] >= 1, (x["e"] + 1023) * 4503599627370496 + whole(x["m"] - 1)).otherwise(whole(x["m"]))
    finite = lambda a: let(let(scaled(a, F.greatest(F.floor(F.log2(a)), F.lit(-1022)).cast("bigint")), lambda x: fixed(a, x)), packed)
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), F.lit(-9223372036854775808)).otherwise(F.lit(0).cast("bigint"))
    size = F.abs(value)
    bits = F.when(size == float("inf"), F.lit(9218868437227405312)).when(size == 0, F.lit(0).cast("bigint")).otherwise(let(size, finite))
    return F.when(F.isnan(value), F.lit(9221120237041090560)).otherwise(bits.bitwiseOR(sign))


def write_checksum(series_id: Column, timestamp: Column, value: Column) -> Column:
    """``31 * (31 * hash(id) + hash(timestamp)) + hash(value)`` as a signed 32-bit integer."""
    h = _fold(_fold(_string_hash(series_id), _long_hash(timestamp)), let(double_bits(value), _long_hash))
    return let(h, lambda x: F.when(x > 2147483647, x - 4294967296).otherwise(x)).cast(T.IntegerType())
