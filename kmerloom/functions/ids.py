"""Record ids packed into one number: file, record offset and position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(value: Column, bits: int, what: str) -> Column:
    return F.when((value >= 0) & (value < 1 << bits), value.cast("long")).otherwise(F.raise_error(F.lit(f"{what} needs more than {bits} bits")).cast("long"))


def pack_short(file_id: Column, record_start: Column, offset: Column) -> Column:
    """[file 8][record start 40][offset in the record 16]; an overflow raises an error."""
    return F.shiftleft(_checked(file_id, 7, "file"), 56).bitwiseOR(F.shiftleft(_checked(record_start, 40, "record start"), 16)).bitwiseOR(_checked(offset, 16, "offset"))


def unpack_short(code: Column) -> Column:
    return F.struct(F.shiftrightunsigned(code, 56).cast("int").alias("file_id"), F.shiftrightunsigned(code, 16).bitwiseAND(F.lit((1 << 40) - 1)).alias("record_start"), code.bitwiseAND(F.lit((1 << 16) - 1)).alias("offset"))


def advanced(code: Column, n: Column) -> Column:
    """A short id moved n places on in its record (back for a negative n); leaving the 16 bits of the offset raises an error."""
    offset = code.bitwiseAND(F.lit((1 << 16) - 1)) + n
    return code - code.bitwiseAND(F.lit((1 << 16) - 1)) + _checked(offset, 16, "offset")


def distance(a: Column, b: Column) -> Column:
    """Places from b to a in one record; null for ids of different records."""
    return F.when(F.shiftrightunsigned(a, 16) == F.shiftrightunsigned(b, 16), a.bitwiseAND(F.lit((1 << 16) - 1)) - b.bitwiseAND(F.lit((1 << 16) - 1)))


def pack_long(file_id: Column, seq_index: Column, file_offset: Column) -> Column:
    """[file 8][record number 16][offset in the file 40]; an overflow raises an error."""
    return F.shiftleft(_checked(file_id, 7, "file"), 56).bitwiseOR(F.shiftleft(_checked(seq_index, 16, "record number"), 40)).bitwiseOR(_checked(file_offset, 40, "offset"))


def unpack_long(code: Column) -> Column:
    return F.struct(F.shiftrightunsigned(code, 56).cast("int").alias("file_id"), F.shiftrightunsigned(code, 40).bitwiseAND(F.lit((1 << 16) - 1)).alias("seq_index"), code.bitwiseAND(F.lit((1 << 40) - 1)).alias("file_offset"))
