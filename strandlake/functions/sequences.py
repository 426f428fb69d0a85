"""Scalar functions on nucleotide sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
#: The codes that a normalised sequence may hold.
IUPAC = "ACGTNBDHVRYSWKM-"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bases that one 64-bit word holds at two bits each, with the sign bit unused.
WORD_BASES = 31
#: Matches of at most so many bases are stored as bases, longer ones as a reference to the index.
LITERAL_BASES = 11
#: A packed token's bases stay below this, its rank below 2^32; a literal's flag 64 says that its bases have four bits each.
TOKEN_BASES, ESCAPED = 1 << 24, 64


def normalize(seq: Column) -> Column:
    """ASCII upper case, white space dropped, U as T, ``.`` and ``~`` as gaps, anything else that is no code as N."""
    upper = F.translate(F.regexp_replace(seq, r"[\t-\r ]", ""), f"{ASCII_LOWER}U.~", f"{ASCII_LOWER.upper()}T--".replace("U", "T"))
    return F.regexp_replace(upper, f"[^{IUPAC}]", "N")


def letters_as_bases(text: Column) -> Column:
    """The a, c, g and t of a text in upper case: a sequence corpus from prose."""
    return F.upper(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^acgt]", ""))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def pack_2bit(seq: Column) -> Column:
    """Up to 31 bases as a long, two bits each, the first base lowest; null for a sequence with anything but bases."""
    digits = F.translate(F.reverse(seq), BASES, "0123")
    packed = F.when(seq == "", F.lit(0)).otherwise(F.conv(digits, 4, 10).cast("long"))
    return F.when(seq.rlike("^[ACGT]*$") & (F.length(seq) <= WORD_BASES), packed)


def unpack_2bit(word: Column, length: Column) -> Column:
    digits = F.lpad(F.conv(word.cast("string"), 10, 4), length, F.lit("0"))
    return F.when(length == 0, F.lit("")).otherwise(F.reverse(F.translate(digits, "0123", BASES)))


def suffix(seq: Column, length: Column) -> Column:
    return F.when(length > 0, F.right(seq, length)).otherwise(F.lit(""))


def common_prefix(a: Column, b: Column, k: int) -> Column:
    """How many leading characters two strings share, up to k."""
    n = F.size(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: (F.left(a, i) == F.left(b, i)) & (F.length(a) >= i) & (F.length(b) >= i)))
    return F.when(a.isNull() | b.isNull(), F.lit(0)).otherwise(n)


def rechunk(seq: Column, size: int = WORD_BASES) -> Column:
    """A sequence in pieces of ``size`` bases, the last one shorter."""
    return F.when(seq == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(seq, F.lit(f".{{1,{size}}}"), 0))


def pack_4bit(seq: Column) -> Column:
    """Bases of any code as a long, four bits each, the first base lowest; null for anything else."""
    digits = F.translate(F.reverse(seq), IUPAC, "0123456789ABCDEF")
    return F.when(seq.rlike(f"^[{IUPAC}]{{1,{LITERAL_BASES}}}$"), F.conv(digits, 16, 10).cast("long"))


def pack_token(is_literal: Column, rank: Column, length: Column, first: Column, literal: Column) -> Column:
    """A token as a long, null where it has no such form. Top byte: bit 0 first, bit 1 literal, then a literal's length, then ESCAPED.

    Below: rank and length, or bases.
    """
    fits = (rank >= 0) & (rank < 1 << 32) & (length < TOKEN_BASES)
    reference = F.when(fits, rank.bitwiseOR(F.shiftleft(length.cast("long"), 32)).bitwiseOR(F.shiftleft(first.cast("long"), 56)))
    flags = (first.cast("long") + 2).bitwiseOR(F.shiftleft(length.cast("long"), 2))
    plain = pack_2bit(literal).bitwiseOR(F.shiftleft(flags, 56))
    escaped = pack_4bit(literal).bitwiseOR(F.shiftleft(flags.bitwiseOR(ESCAPED), 56))
    return F.when(is_literal, F.when(length <= LITERAL_BASES, F.coalesce(plain, escaped))).otherwise(reference)


def token_flags(word: Column) -> Column:
    return F.shiftrightunsigned(word, 56).bitwiseAND(255).cast("int")


def token_rank(word: Column) -> Column:
    return word.bitwiseAND(0xFFFFFFFF)


def token_length(word: Column) -> Column:
    flags = token_flags(word)
    reference = F.shiftrightunsigned(word, 32).bitwiseAND(0xFFFFFF).cast("int")
    return F.when(flags.bitwiseAND(2) == 2, F.shiftright(flags, 2).bitwiseAND(15)).otherwise(reference)


def token_literal(word: Column) -> Column:
    below, length = word.bitwiseAND((1 << 56) - 1), token_length(word)
    digits = F.lpad(F.conv(below.cast("string"), 10, 16), length, F.lit("0"))
    escaped = F.reverse(F.translate(digits, "0123456789ABCDEF", IUPAC))
    return F.when(token_flags(word).bitwiseAND(ESCAPED) == ESCAPED, escaped).otherwise(unpack_2bit(below, length))


def register(spark: SparkSession) -> None:
    """The functions under SQL names, as SQL functions of the session."""
    spark.sql(f"create or replace temporary function seq_normalize(s string) returns string return regexp_replace(translate(regexp_replace(s, '[\\\\t-\\\\r ]', ''), '{ASCII_LOWER}U.~', '{ASCII_LOWER.upper().replace("U", "T")}T--'), '[^{IUPAC}]', 'N')")
    spark.sql("create or replace temporary function seq_revcomp(s string) returns string return translate(reverse(s), 'ACGT', 'TGCA')")
    spark.sql("create or replace temporary function seq_pack2(s string) returns bigint return case when s = '' then 0 when s rlike '^[ACGT]{1,31}$' then cast(conv(translate(reverse(s), 'ACGT', '0123'), 4, 10) as bigint) end")
    spark.sql("create or replace temporary function seq_unpack2(w bigint, n int) returns string return case when n = 0 then '' else reverse(translate(lpad(conv(cast(w as string), 10, 4), n, '0'), '0123', 'ACGT')) end")
