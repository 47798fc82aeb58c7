"""Text handling shared by the operators: all of it on UTF-8 bytes, inside Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The white space of words and lines: space and the bytes 9 to 13.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def as_text(values: list[bytes | None]) -> pa.Array:
    """Bytes that are UTF-8 already, as a string column."""
    return pa.array(values, pa.large_binary()).cast(pa.large_string()).cast(pa.string())


def lowest(frame: DataFrame, key: str, most: int, count: int) -> DataFrame:
    """At most so many of the frame's ``count`` rows: those whose keys hash lowest.

    Hashes are even, so a bound on them leaves half as many again, whatever the number of rows and
    of partitions; only these are put in order.
    """
    hashed = F.xxhash64(key)
    if count > 2 * most:
        frame = frame.filter(hashed / float(1 << 64) + 0.5 < 1.5 * most / count)
    return frame.orderBy(hashed, key).limit(most)


def crc32_rest(key: Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo a number; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
