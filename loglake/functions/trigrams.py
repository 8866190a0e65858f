"""Trigram sets of messages: which three-character runs occur, over an alphabet of 37 symbols.

Text is lower-cased the way ILIKE does it, then every character outside a-z and 0-9 becomes one symbol. A term whose
trigrams are not all in a set cannot occur in the text, so a file without them may be skipped; the
reverse does not hold. All expressions are native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols in order of their number; the last stands for every other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_"
SYMBOLS = len(ALPHABET)
SPACE = SYMBOLS**3


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "_")


def runs(text: Column) -> Column:
    """The three-character runs of a text in order, repeated ones too; null for null. One pass over the text, and no lambda, whose body
    would evaluate the text's expression anew for each place."""
    return F.regexp_extract_all(folded(text), F.lit("(?=(...))"), F.lit(1))


def run_id(run: Column) -> Column:
    """Number of a three-character run."""
    a, b, c = (F.instr(F.lit(ALPHABET), F.substring(run, k, 1)) - 1 for k in (1, 2, 3))
    return (a * SYMBOLS + b) * SYMBOLS + c


def ids(text: Column) -> Column:
    """Distinct trigram ids of a text, empty for fewer than three characters, null for null."""
    return F.array_distinct(F.transform(runs(text), run_id))


def sets(rows: DataFrame, keys: list[str], text: Column, short: bool = False, term: str | None = None) -> DataFrame:
    """``keys`` and t, each trigram id of a key once, or each of a term's. With ``short`` a key without any has a row with null.

    Runs are made distinct before they are numbered, so a row costs what its length does.
    """
    spread = F.explode_outer if short else F.explode
    found = rows.select(*keys, spread(runs(text)).alias("t"))
    if term is not None:
        found = found.where(F.col("t").isin(term_runs(term)))
    return found.distinct().select(*keys, run_id(F.col("t")).alias("t"))


def term_ids(term: str) -> list[int]:
    """The same for a search term, on the driver."""
    codes = [ALPHABET.find(c) if c in ALPHABET[:-1] else SYMBOLS - 1 for c in term.lower()]
    return sorted({(a * SYMBOLS + b) * SYMBOLS + c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)})


def term_runs(term: str) -> list[str]:
    """The same as characters."""
    return [ALPHABET[t // SYMBOLS**2] + ALPHABET[t // SYMBOLS % SYMBOLS] + ALPHABET[t % SYMBOLS] for t in term_ids(term)]


def may_contain(trigrams: Column, term: str) -> Column:
    """False only on proof: a recorded set that lacks a trigram of the term."""
    wanted = term_ids(term)
    if not wanted:
        return F.lit(True)
    return trigrams.isNull() | (F.size(F.array_except(F.array(*[F.lit(i) for i in wanted]), trigrams)) == 0)


# ---------------------------------------------------------------- compact encoding


def encode(members: list[int]) -> bytes:
    """Sparse (marker, count, 16-bit ids) or dense bits, whichever is smaller. The sparse form has odd length."""
    members = sorted(set(members))
    dense = (SPACE + 7) // 8
    if 3 + 2 * len(members) < dense:
        return b"\x01" + len(members).to_bytes(2, "little") + b"".join(m.to_bytes(2, "little") for m in members)
    bits = bytearray(dense)
    for m in members:
        bits[m >> 3] |= 1 << (m & 7)
    return bytes(bits)


def decode(data: bytes | None) -> list[int] | None:
    """The ids, or None (not recorded) for anything malformed."""
    if not data:
        return None
    if len(data) == (SPACE + 7) // 8:
        found = [i * 8 + b for i, byte in enumerate(data) for b in range(8) if byte >> b & 1]
    elif data[0] == 1 and len(data) >= 3 and len(data) == 3 + 2 * int.from_bytes(data[1:3], "little"):
        found = [int.from_bytes(data[i : i + 2], "little") for i in range(3, len(data), 2)]
    else:
        return None
    return found if all(i < SPACE for i in found) and found == sorted(set(found)) else None
