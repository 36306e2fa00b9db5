"""Folding and coercion of cell values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Unicode white space at either end; ``trim`` knows the space alone.
_ENDS = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def folded(c: Column) -> Column:
    """Stripped and case-folded, for comparisons that ignore case."""
    return F.replace(F.lower(stripped(c)), F.lit("ß"), F.lit("ss"))


def fold(value: str) -> str:
    """The same of a literal."""
    return value.strip().lower().replace("ß", "ss")


def normalized(c: Column) -> Column:
    """Folded, punctuation turned into spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


#: Decimal numbers alone: a cast would also take type suffixes and hexadecimal.
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"


def numeric(c: Column, kind: DataType) -> Column:
    """The value as a double; null if it is none, NaN included."""
    if isinstance(kind, NumericType):
        out = c.cast("double")
    elif isinstance(kind, BooleanType):
        out = c.cast("int").cast("double")
    elif isinstance(kind, StringType):
        plain = stripped(c)
        out = F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(out), out)


def moment(c: Column, kind: DataType) -> Column:
    """The value as a timestamp without time zone; null if it is none."""
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        return c.cast("timestamp_ntz")
    return stripped(c).try_cast("timestamp_ntz") if isinstance(kind, StringType) else F.lit(None).cast("timestamp_ntz")


def blank(c: Column, kind: DataType) -> Column:
    return c.isNull() | F.isnan(c) if kind.typeName() in ("double", "float") else c.isNull()


# The Latin letters for Bulgarian ones.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
}


def transliterated(c: Column) -> Column:
    """Bulgarian letters of folded text as Latin ones, single letters in one pass."""
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for letter, latin in CYRILLIC.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


# Markers of currencies in folded number formats, the first that is found counts.
CURRENCIES = [("€", "EUR"), ("eur", "EUR"), ("лв", "BGN"), ("bgn", "BGN"), ("$", "USD"), ("usd", "USD"), ("£", "GBP"), ("gbp", "GBP")]
SYMBOLS = {"EUR": "€", "USD": "$", "GBP": "£", "BGN": "лв "}


def currency(number_format: Column) -> Column:
    """The code of the currency that a number format shows, whatever its case."""
    out, plain = F.lit(None).cast("string"), F.lower(number_format)
    for marker, code in reversed(CURRENCIES):
        out = F.when(plain.contains(marker), F.lit(code)).otherwise(out)
    return out


def formatted(value: Column, code: Column | None = None, count: bool = False) -> Column:
    """A number as it is shown to a reader: ``n/a`` for null, groups of thousands, two decimals unless both are 0, the currency's sign before it."""
    shown = F.format_number(value, 0) if count else F.regexp_replace(F.format_number(value, 2), r"\.00$", "")
    if code is not None:
        for name, symbol in SYMBOLS.items():
            shown = F.when(code == name, F.concat(F.lit(symbol), shown)).otherwise(shown)
    return F.coalesce(shown, F.lit("n/a"))


def display_decimals(number_format: Column) -> Column:
    """How many decimals a fixed-decimal number format shows; null for formats that show none fixed.

    The format's first section counts, without quoted, bracketed and escaped parts.
    """
    first = F.regexp_extract(number_format, r'^((?:"[^"]*"|\\.|\[[^\]]*\]|[^;"\\\[])*)', 1)
    bare = F.regexp_replace(first, r'"[^"]*"|\\.|\[[^\]]*\]|[_*].', "")
    no_number = bare.rlike(r"(?i)general|[@%]|[ymdhs]|e[+-]") | ~bare.rlike("[0#?]")
    decimals = F.regexp_extract(bare, r"\.([0#?]*)", 1)
    return F.when(~no_number & ~decimals.rlike("[#?]"), F.length(decimals))


#: Decimals that stored figures are held with; formats with more show them as they are.
DECIMALS = 12
#: Figures from here on have no exact form, so that the sums of a whole column still have one.
EXACT_BELOW = 9e17


def exact(c: Column) -> Column:
    """A double as the decimal that its shortest text names, up to ``DECIMALS`` places; null from ``EXACT_BELOW`` on."""
    return F.when(F.abs(c) < EXACT_BELOW, c.cast("string").try_cast(f"decimal(36,{DECIMALS})"))


def display_unit(decimals: Column) -> Column:
    """The least step that so many decimals show; null of null."""
    steps = F.array(*[F.lit(f"{10**-d:.{DECIMALS}f}").cast(f"decimal(13,{DECIMALS})") for d in range(DECIMALS + 1)])
    return F.when(decimals.isNotNull(), F.get(steps, F.least(decimals, F.lit(DECIMALS))))


def display_rounded(c: Column, decimals: Column) -> Column:
    """A double as it is displayed: half away from zero, from its shortest decimal text."""
    unit = display_unit(decimals)
    up = F.abs(exact(c)) + unit * F.lit("0.5").cast("decimal(2,1)")
    size = (up - up % unit).cast(f"decimal(36,{DECIMALS})")
    return F.when(c < 0, -size).otherwise(size)
