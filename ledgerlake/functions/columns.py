"""Column helpers: money, dates, months, identity text, hashes."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,2)"
TOTAL = "decimal(38,2)"
#: White space as Unicode text splitting has it (fixed values).
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def month_of(day: Column | str) -> Column:
    return F.trunc(F.col(day) if isinstance(day, str) else day, "MM")


def month_text(month: Column | str) -> Column:
    return F.date_format(month, "yyyy-MM")


def strict_date(text: Column) -> Column:
    """``DD.MM.YYYY`` with all its digits and a real date, else null."""
    return F.when(text.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.try_to_date(text, "dd.MM.yyyy"))


def danish_decimal(text: Column, places: int = 2) -> Column:
    """Decimal comma, groups of three by points; null for anything else or too many places, never rounded."""
    good = text.rlike(rf"^-?([0-9]+|[0-9]{{1,3}}(\.[0-9]{{3}})+)(,[0-9]{{1,{places}}})?$")
    plain = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")
    return F.when(good, plain.try_cast(MONEY))


def identity_text(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def label(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", ""), F.lit(""))


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to another one, these, and those that fold to several, by Unicode's full case folding as Python has it."""
    changed = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != chr(c).casefold()}
    single = {a: b for a, b in changed.items() if len(b) == 1}
    return "".join(single), "".join(single.values()), {a: b for a, b in changed.items() if len(b) > 1}


def fold(text: Column) -> Column:
    """Full case folding, letter by letter; a text of Latin-1 letters without ß and µ is only lowered, which is the same."""
    before, after, several = _foldings()
    letters = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), several.items(), text)
    letters = F.when(text.rlike(f"[{''.join(several)}]"), letters).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\xB4\xB6-\xDE\xE0-\xFF]"), F.translate(letters, before, after)).otherwise(F.lower(text))


#: Decimal places of the currencies that amounts may be in; one that isn't here is refused (fixed values).
PLACES = {"DKK": 2}


def minor_units(amount: Column, currency: Column) -> Column:
    """An amount's text (digits, with a point before decimal places) as a whole number of its currency's minor unit, ``units``, or why it has none, ``refusal``.

    Nothing is rounded: more places than the currency has are refused, even zeros,
    and so is what doesn't fit in 64 bits, or a currency that isn't known.
    """
    places = F.element_at(F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair]), currency)
    point = F.instr(amount, ".")
    given = F.when(point > 0, F.char_length(amount) - point).otherwise(0)
    units = F.concat(F.replace(amount, F.lit("."), F.lit("")), F.repeat(F.lit("0"), places - given)).try_cast("long")
    # One pattern a row, and only its text after it: patterns are what costs here.
    refusal = (
        F.when(places.isNull(), "unknown-currency")
        .when(~F.coalesce(amount.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), F.lit(False)), "not-an-amount")
        .when(given > places, "excess-places")
        .when(units.isNull(), "out-of-range")
    )
    return F.struct(F.when(refusal.isNull(), units).alias("units"), refusal.alias("refusal"))


def from_minor_units(units: Column, currency: Column) -> Column:
    """The exact amount of a number of minor units; null for a currency that isn't known."""
    return F.when(currency.isin(*PLACES), (units.cast("decimal(19,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(21,2)"))


def hash_parts(*parts: Column) -> Column:
    """SHA-256 of the parts as a compact JSON array of strings."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def transaction_id(account: Column, day: Column, amount: Column, text: Column, k: Column) -> Column:
    return hash_parts(F.lit("1"), account, F.date_format(day, "yyyy-MM-dd"), amount.cast(MONEY), identity_text(text), k)


def derived_type(direction: Column, amount: Column) -> Column:
    """What a category's direction makes of an amount; a refund runs against its category."""
    return (
        F.when(amount == 0, "unknown")
        .when((direction == "income") & (amount > 0), "income")
        .when((direction == "expense") & (amount < 0), "expense")
        .when(direction.isin("income", "expense"), "refund")
        .otherwise("unknown")
    )


def sum_if(condition: Column, value: Column) -> Column:
    """Sum of a money column where a condition holds, 0 if nowhere."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast(TOTAL)
