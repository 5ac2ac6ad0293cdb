"""Column expressions for amounts, percentages, times, hashes and identifiers. All JVM-side.

Amounts at rest are decimal texts in base units; arithmetic is DECIMAL with ANSI overflow errors.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text patterns of a plain decimal and of an integer, and the native-asset address.
DECIMAL_TEXT = r"^-?[0-9]+(\.[0-9]+)?$"
INTEGER_TEXT = r"^-?[0-9]+$"
ADDRESS_TEXT = r"^0x[0-9a-fA-F]{40}$"
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
SECONDS_PER_DAY = 86400


def _rounded(x: Column, scale: int, mode: str) -> Column:
    if mode == "half_up":
        return F.round(x, scale)
    if mode == "ceil":
        return F.ceil(x, scale)
    if mode == "floor":
        return F.floor(x, scale)
    raise ValueError(f"unknown rounding mode: {mode}")


def to_fixed_point(x: Column, decimals: int = 18, mode: str = "half_up") -> Column:
    """Decimal amount to base units, DECIMAL(38,0). The point is dropped from the text, so no product can overflow early."""
    text = _rounded(x, decimals, mode).cast(f"decimal(38,{decimals})").cast("string")
    return F.replace(text, F.lit("."), F.lit("")).cast("decimal(38,0)")


def from_fixed_point(units: Column, decimals: int = 18) -> Column:
    """Base units to a decimal amount. Digits are moved, not divided, so the result is exact."""
    padded = F.lpad(F.abs(units).cast("decimal(38,0)").cast("string"), 39, "0")
    text = F.regexp_replace(padded, f"^([0-9]{{{39 - decimals}}})([0-9]{{{decimals}}})$", "$1.$2")
    return F.concat(F.when(units < 0, "-").otherwise(""), text).cast(f"decimal(38,{decimals})")


def parse_decimal(text: Column, decimals: int, mode: str = "floor") -> Column:
    """A plain decimal text (no exponent) at ``decimals`` places; anything else is an error.

    Rounding is on the magnitude, so floor cuts towards zero.
    """
    trimmed = F.trim(text)
    bad = F.raise_error(F.concat(F.lit("not a valid decimal string: "), text)).cast(f"decimal(38,{decimals})")
    fraction = F.regexp_extract(trimmed, r"\.([0-9]+)$", 1)
    dropped = F.substring(fraction, F.lit(decimals + 1), F.greatest(F.length(fraction) - decimals, F.lit(0)))
    up = {"floor": F.lit(False), "ceil": dropped.rlike("[1-9]"), "half_up": dropped.rlike("^[5-9]")}[mode]
    minus = F.startswith(trimmed, F.lit("-"))
    kept = F.concat(
        F.when(minus, "-").otherwise(""), F.regexp_extract(trimmed, "([0-9]+)", 1), F.rpad(F.substring(fraction, 1, decimals), decimals, "0")
    )
    carry = F.when(~up, 0).when(minus, -1).otherwise(1).cast("decimal(1,0)")
    signed = from_fixed_point((kept.cast("decimal(38,0)") + carry).cast("decimal(38,0)"), decimals)
    return F.when(trimmed.rlike(DECIMAL_TEXT), signed).otherwise(F.when(text.isNotNull(), bad))


def is_base_units(text: Column) -> Column:
    return F.trim(text).rlike(INTEGER_TEXT)


def base_units(text: Column) -> Column:
    """Base-unit text to DECIMAL(38,0); a decimal point or other text is an error."""
    bad = F.raise_error(F.concat(F.lit("not a valid integer base-units string: "), text)).cast("decimal(38,0)")
    return F.when(is_base_units(text), F.trim(text).cast("decimal(38,0)")).otherwise(F.when(text.isNotNull(), bad))


def mul_fixed(a: Column, b: Column, decimals: int, mode: str = "floor") -> Column:
    """Product rounded to ``decimals``; the operands' DECIMAL types decide how many digits survive (<= 38 in total)."""
    return _rounded(a * b, decimals, mode)


def div_fixed(a: Column, b: Column, decimals: int, mode: str = "floor") -> Column:
    """Quotient of non-negative amounts at ``decimals`` places, rounded on the exact remainder; b = 0 is an ANSI error.

    DECIMAL division itself keeps only a few places of a wide operand, so the remainder decides the rounding.
    """
    unit = b * F.lit(f"1e-{decimals}" if decimals else "1").cast(f"decimal({max(decimals, 1)},{decimals})")
    rest = a % unit
    whole = ((a - rest) / unit).cast("decimal(38,0)")
    up = {"floor": F.lit(False), "ceil": rest > 0, "half_up": rest * 2 >= unit}[mode]
    steps = (whole + F.when(up, 1).otherwise(0)).cast("decimal(38,0)")
    return from_fixed_point(steps, decimals) if decimals else steps


def format_fixed(x: Column, min_frac: int = 0, max_frac: int = 6, grouping: bool = True) -> Column:
    """Grouped number text, half-up at ``max_frac`` digits, zeros trimmed down to ``min_frac`` digits."""
    if max_frac < min_frac:
        raise ValueError(f"max_frac ({max_frac}) must be >= min_frac ({min_frac})")
    text = F.format_number(F.round(x, max_frac), max_frac)
    if not grouping:
        text = F.replace(text, F.lit(","), F.lit(""))
    if max_frac > min_frac:
        keep = rf"(\.[0-9]{{{min_frac}}}[0-9]*?)0+$" if min_frac else r"(\.[0-9]*?)0+$"
        text = F.regexp_replace(F.regexp_replace(text, keep, "$1"), r"\.$", "")
    return F.regexp_replace(text, r"^-([0,]*\.?0*)$", "$1")


def format_fraction(x: Column, digits: int = 2) -> Column:
    return F.concat(format_fixed(x * 100, digits, digits), F.lit("%"))


def format_amount(x: Column, symbol: str | Column, max_frac: int = 6) -> Column:
    return F.concat(format_fixed(x, 0, max_frac), F.lit(" "), F.lit(symbol) if isinstance(symbol, str) else symbol)


def to_usd(amount: Column, spot: Column) -> Column:
    return F.round(amount * spot, 2)


def format_usd(x: Column) -> Column:
    return F.concat(F.lit("$"), format_fixed(x, 2, 2))


def format_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def format_duration(seconds: Column) -> Column:
    """``1d 4h 32m``; seconds only below a minute; leading zero units are left out."""
    total = F.abs(seconds.cast("bigint"))
    part = lambda unit, modulo=None: F.floor(total / unit) if modulo is None else F.floor(total / unit) % modulo
    text = F.concat_ws(
        " ",
        F.when(total >= 86400, F.concat(part(86400).cast("string"), F.lit("d"))),
        F.when(total >= 3600, F.concat(part(3600, 24).cast("string"), F.lit("h"))),
        F.when(total >= 60, F.concat(part(60, 60).cast("string"), F.lit("m"))),
        F.when(total < 60, F.concat(total.cast("string"), F.lit("s"))),
    )
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text)


def seconds_remaining(expiry: Column, now: Column) -> Column:
    """Whole seconds until ``expiry``, negative once past; expired from 0 on."""
    return F.floor((F.unix_micros(expiry.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000).cast("bigint")


def short_hex(text: Column, chars: int = 6) -> Column:
    """``0x1a2b3c...f00dba`` with an ellipsis; other or short text comes back unchanged."""
    fits = F.startswith(text, F.lit("0x")) & (F.length(text) > 2 + 2 * chars)
    return F.when(fits, F.concat(F.substring(text, 1, 2 + chars), F.lit("…"), F.right(text, F.lit(chars)))).otherwise(text)


def same_address(a: Column, b: Column) -> Column:
    """Case-insensitive; false when either is not an address."""
    both = a.rlike(ADDRESS_TEXT) & b.rlike(ADDRESS_TEXT)
    return F.coalesce(both & (F.lower(a) == F.lower(b)), F.lit(False))


def coerce_integer(text: Column) -> Column:
    """An integer of any length as its shortest text, null for anything that is not one."""
    trimmed = F.trim(text)
    shortest = F.regexp_replace(trimmed, "^(-?)0+(?=[0-9])", "$1")
    return F.when(trimmed.rlike(INTEGER_TEXT), F.when(shortest == "-0", "0").otherwise(shortest))


def conf_key(c: Column) -> Column:
    return F.format_string("%.4f", c)


def horizon_seconds(days: Column) -> Column:
    return days * SECONDS_PER_DAY


def epoch_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def normalize_asset(address: Column) -> Column:
    """The zero address means the native asset: null."""
    return F.nullif(F.lower(address), F.lit(ZERO_ADDRESS))


def asset_label(settlement_asset: Column, native: str = "POL") -> Column:
    return F.when(settlement_asset.isNull(), native).otherwise("ERC20")
