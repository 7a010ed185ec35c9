"""Alphabets as descriptors that compile to Column expressions.

Fixed values: the symbols of each alphabet in code order, its complements, and the characters that are read as another symbol.
Symbols a table leaves without a letter of their own are written as a digit in the order key only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """symbols: in code order; complement: code of each code's complement; unknown: what other characters become; alias: read as."""

    name: str
    symbols: str
    complement: tuple[int, ...]
    unknown: str
    alias: dict[str, str] = field(default_factory=dict)

    @property
    def bits(self) -> int:
        return max(1, (len(self.symbols) - 1).bit_length())

    def _readable(self) -> dict[str, str]:
        """Each accepted upper-case character and the symbol it becomes."""
        own = {c: c for c in self.symbols if c != "?"}
        return own | self.alias

    def normalise(self, seq: Column) -> Column:
        """seq in this alphabet's symbols, character for character; lower case is read as upper case."""
        read = self._readable()
        keep = "".join(sorted(read))
        cls = "".join(f"\\{c}" if c in ".-?" else c for c in keep + "".join(c.lower() for c in keep if c.isalpha()))
        out = F.upper(F.regexp_replace(seq, f"[^{cls}]", self.unknown))
        moved = {c: s for c, s in read.items() if c != s}
        return F.translate(out, "".join(moved), "".join(moved.values())) if moved else out

    def normalise_sql(self, seq: str) -> str:
        """normalise() in SQL."""
        read = self._readable()
        keep = "".join(sorted(read))
        cls = "".join(f"\\{c}" if c in ".-?" else c for c in keep + "".join(c.lower() for c in keep if c.isalpha()))
        out = f"upper(regexp_replace({seq}, '[^{cls}]', '{self.unknown}', 'g'))"
        moved = {c: s for c, s in read.items() if c != s}
        return f"translate({out}, '{''.join(moved)}', '{''.join(moved.values())}')" if moved else out

    def _unique(self) -> str:
        """The symbols with a stand-in for each second of two alike."""
        out = ""
        for i, c in enumerate(self.symbols):
            out += c if c not in out else chr(0x61 + i)
        return out

    def complement_of(self, seq: Column) -> Column:
        s = self._unique()
        return F.translate(seq, s, "".join(s[i] for i in self.complement))

    def reverse_complement(self, seq: Column) -> Column:
        return F.reverse(self.complement_of(seq))

    def order_key(self, seq: Column) -> Column:
        """A text that sorts as the codes do: a hexadecimal digit for each symbol."""
        s = self._unique()
        return F.translate(seq, s, "0123456789ABCDEF"[: len(s)])

    @property
    def sorts_as_text(self) -> bool:
        return list(self.symbols) == sorted(self.symbols)

    def canonical(self, kmer: Column) -> Column:
        """The lesser of a k-mer and its reverse complement, by codes."""
        rc = self.reverse_complement(kmer)
        if self.sorts_as_text:
            return F.least(kmer, rc)
        return F.when(self.order_key(kmer) <= self.order_key(rc), kmer).otherwise(rc)

    def greater(self, kmer: Column) -> Column:
        rc = self.reverse_complement(kmer)
        if self.sorts_as_text:
            return F.greatest(kmer, rc)
        return F.when(self.order_key(kmer) >= self.order_key(rc), kmer).otherwise(rc)

    def pack(self, kmer: Column) -> Column:
        """The k-mer as one number, first character highest; for k * bits up to 62."""
        s = self._unique()
        digits = "0123456789ABCDEF"[: len(s)]
        return F.conv(F.translate(kmer, s, digits), 1 << self.bits, 10).cast("long")

    def unpack(self, code: Column, k: int) -> Column:
        s = self._unique()
        return F.translate(F.lpad(F.conv(code.cast("string"), 10, 1 << self.bits), k, "0"), "0123456789ABCDEF"[: len(s)], s)


# Fixed values.
DNA = Alphabet("DNA", "ACGT", (3, 2, 1, 0), "A")
RNA = Alphabet("RNA", "ACGU", (3, 2, 1, 0), "A")
DNA6 = Alphabet("DNA6", ".A?CT?GN", (0, 4, 2, 6, 1, 5, 3, 7), "?", {"-": ".", "X": "N"})
RNA6 = Alphabet("RNA6", ".A?CU?GN", (0, 4, 2, 6, 1, 5, 3, 7), "?", {"-": ".", "X": "N"})
DNA_IUPAC = Alphabet("DNA_IUPAC", "UACMGRSVTWYHKDBN", (1, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15), "N")
DNA16 = Alphabet("DNA16", ".ACMGRSVTWYHKDBN", (0, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15), "N", {"-": ".", "U": "T"})
DNA5, RNA5 = DNA6, RNA6
ALPHABETS = {a.name: a for a in (DNA, RNA, DNA6, RNA6, DNA_IUPAC, DNA16)}
