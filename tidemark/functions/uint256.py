"""256-bit integers: 64-digit hex words to decimal text and back, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = 64
_LIMBS = 9

# One SQL text per word keeps the plan cheap to build: a log row has many words.
_TINY = "conv(right({w}, 16), 16, 10)"
_SMALL = (
    "cast(cast(conv(substring({w}, 34, 15), 16, 10) as decimal(19,0)) * cast('18446744073709551616' as decimal(20,0))"
    " + cast(conv(right({w}, 16), 16, 10) as decimal(20,0)) as string)"
)
# limbs = limbs * 2^32 + part, for the eight 32-bit parts; limbs hold nine decimal digits, least significant first.
_CARRIED = (
    "aggregate(limbs, named_struct('c', cast(conv(substring({w}, part * 8 + 1, 8), 16, 10) as bigint), 'out', cast(array() as array<bigint>)),"
    " (acc, limb) -> named_struct('c', (limb * 4294967296 + acc.c) div 1000000000,"
    " 'out', concat(acc.out, array((limb * 4294967296 + acc.c) % 1000000000))), acc -> acc.out)"
)
_LARGE = (
    "regexp_replace(array_join(transform(reverse(aggregate(sequence(0, 7), array_repeat(cast(0 as bigint), " + str(_LIMBS) + "),"
    " (limbs, part) -> " + _CARRIED + ")), x -> lpad(cast(x as string), 9, '0')), ''), '^0+(?=[0-9])', '')"
)


def decimal_text(word: str) -> str:
    """SQL text turning ``word``, SQL text of a 64-digit hex word, into decimal text.

    Below 2^64 it is one base conversion, below 2^124 (every real token amount) two DECIMAL limbs; above, a fold of
    eight 32-bit parts over limbs of nine decimal digits.
    """
    cases = f"case when startswith({{w}}, '{'0' * 48}') then {_TINY} when startswith({{w}}, '{'0' * 33}') then {_SMALL} else {_LARGE} end"
    return cases.format(w=word)


def hex_word(amount: Column) -> Column:
    """A non-negative amount below 2^95 as a 64-digit hex word."""
    value = amount.cast("decimal(38,0)")
    low = (value % F.lit(2**32).cast("decimal(10,0)")).cast("bigint")
    high = ((value - low) / F.lit(2**32).cast("decimal(10,0)")).cast("decimal(20,0)").cast("bigint")
    return F.lower(F.concat(F.lpad(F.hex(high), 56, "0"), F.lpad(F.hex(low), 8, "0")))
