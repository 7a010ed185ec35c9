"""k-mers as texts or packed numbers: append, compare, shift, cut, combine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import Alphabet


def from_string(seq: Column, k: int) -> Column:
    """The first k characters."""
    return F.left(seq, F.lit(k))


def append(kmer: Column, char: Column) -> Column:
    """Drops the first character and puts char at the end."""
    return F.concat(F.substring(kmer, 2, 1 << 30), char)


def prepend(kmer: Column, char: Column, k: int) -> Column:
    """Puts char at the front and drops the last character."""
    return F.concat(char, F.left(kmer, F.lit(k - 1)))


def prefix(kmer: Column, n: int) -> Column:
    return F.left(kmer, F.lit(n))


def infix(kmer: Column, n: int, offset: int) -> Column:
    return F.substring(kmer, offset + 1, n)


def suffix(kmer: Column, n: int) -> Column:
    return F.right(kmer, F.lit(n))


def chars_at(kmer: Column, k: int, pos: int, n: int = 1) -> Column:
    """n characters that end at place pos, where place 0 is the last character."""
    return F.substring(kmer, k - pos - n + 1, n)


def set_char_at(kmer: Column, k: int, pos: int, char: Column) -> Column:
    return F.overlay(kmer, char, F.lit(k - pos), F.lit(1))


def same_but_first(a: Column, b: Column) -> Column:
    return F.substring(a, 2, 1 << 30) == F.substring(b, 2, 1 << 30)


def same_but_last(a: Column, b: Column, k: int) -> Column:
    return F.left(a, F.lit(k - 1)) == F.left(b, F.lit(k - 1))


def mask(k: int, alphabet: Alphabet) -> int:
    return (1 << (k * alphabet.bits)) - 1


def shift_left(code: Column, n: int, k: int, alphabet: Alphabet) -> Column:
    """A packed k-mer moved n characters to the front; code 0 fills the end."""
    return F.shiftleft(code, n * alphabet.bits).bitwiseAND(F.lit(mask(k, alphabet)))


def shift_right(code: Column, n: int, alphabet: Alphabet) -> Column:
    return F.shiftrightunsigned(code, n * alphabet.bits)


def masked_equal(a: Column, b: Column, m: int) -> Column:
    return a.bitwiseXOR(b).bitwiseAND(F.lit(m)) == 0


def xor_reverse_complement(kmer: Column, alphabet: Alphabet) -> Column:
    """A key that both strands share: the packed k-mer XOR that of its reverse complement."""
    return alphabet.pack(kmer).bitwiseXOR(alphabet.pack(alphabet.reverse_complement(kmer)))


def compare(a: Column, b: Column, alphabet: Alphabet) -> Column:
    """-1, 0 or 1 by codes, first character first."""
    x, y = (a, b) if alphabet.sorts_as_text else (alphabet.order_key(a), alphabet.order_key(b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def to_hex(code: Column) -> Column:
    return F.hex(code)


def codes(kmer: Column, alphabet: Alphabet) -> Column:
    """The codes of the characters as numbers, joined by spaces."""
    return F.array_join(F.transform(F.split(alphabet.order_key(kmer), ""), lambda c: F.conv(c, 16, 10)), " ")


def place(kmer: Column, parts: int) -> Column:
    """Which of ``parts`` a k-mer is dealt to. The hash is for placement alone."""
    return F.pmod(F.xxhash64(kmer), F.lit(parts)).cast("int")


def place_by_prefix(kmer: Column, n: int) -> Column:
    """Identity placement: the first n characters."""
    return prefix(kmer, n)


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def shift_bits(code: Column, n: int) -> Column:
    """Moved n bits to the front, or to the end for a negative n."""
    return F.shiftleft(code, n) if n >= 0 else F.shiftrightunsigned(code, -n)


def from_hex(text: Column) -> Column:
    """A packed k-mer from its hexadecimal digits, up to 62 bits."""
    return F.conv(text, 16, 10).cast("long")


def code_at(code: Column, k: int, i: int, alphabet: Alphabet) -> Column:
    """The code of character i (from the front) of a packed k-mer."""
    return F.shiftrightunsigned(code, (k - 1 - i) * alphabet.bits).bitwiseAND(F.lit((1 << alphabet.bits) - 1))


def from_string_reversed(seq: Column, k: int) -> Column:
    """The first k characters, last one first."""
    return F.reverse(F.left(seq, F.lit(k)))


def next_codes(code: Column, char_code: Column, k: int, alphabet: Alphabet) -> Column:
    """A packed k-mer moved on by one character of a packed stream."""
    return shift_left(code, 1, k, alphabet).bitwiseOR(char_code)


def pack_wide(kmer: Column, alphabet: Alphabet) -> Column:
    """A k-mer of any length as bytes that sort as its codes do, two symbols a byte; an odd last half is 0."""
    key = alphabet.order_key(kmer)
    return F.unhex(F.when(F.char_length(key) % 2 == 1, F.concat(key, F.lit("0"))).otherwise(key))


def unpack_wide(code: Column, k: int, alphabet: Alphabet) -> Column:
    s = alphabet._unique()
    return F.translate(F.left(F.hex(code), F.lit(k)), "0123456789ABCDEF"[: len(s)], s)
