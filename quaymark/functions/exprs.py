"""Column builders shared by all operators: text normalisation, lenient casts and money rules.

Everything here is a JVM expression, so a plan made of them stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.config import ColumnMapping, ConfigError, MoneyFlags, PriceType

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

#: Tokens that a Boolean override accepts.
TRUE_TOKENS = ("true", "t", "yes", "y", "1", "on")
FALSE_TOKENS = ("false", "f", "no", "n", "0", "off", "")

#: Types an override may name.
OVERRIDE_TYPES = {"Utf8": "string", "Int64": "bigint", "Int32": "int", "Float64": "double", "Float32": "float", "Boolean": "boolean"}

#: Sums are taken over scaled decimals, so that they don't depend on the order in which partitions arrive.
EXACT = "decimal(28,8)"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters that has."""
    return F.col(f"`{name.replace('`', '``')}`")


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c: Column) -> Column:
    return c.cast("string")


def key(c: Column) -> Column:
    """Store key: stripped, lower case; null stays null."""
    return F.lower(strip(text(c)))


def lenient_double(df: DataFrame, name: str) -> Column:
    """Number or null. Text must look like a plain number: padded values and suffixes such as 1d are not numbers."""
    if name not in df.columns:
        raise ConfigError(f"no column {name!r}")
    c = col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return c.cast("double")
    return F.when(text(c).rlike(_NUMBER), text(c).try_cast("double"))


def exact_sum(c: Column) -> Column:
    """Order-independent sum of doubles with at most eight decimals; 0 for no rows. Where a value or the sum doesn't fit the
    decimal, as NaN, infinity and 1e21 don't, the sum is one of doubles."""
    exact = c.try_cast(EXACT)
    total, odd = F.try_sum(exact), F.coalesce(F.bool_or(c.isNotNull() & exact.isNull()), F.lit(False))
    return F.when(~odd & total.isNotNull(), total.cast("double")).otherwise(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)))


def effective_units(df: DataFrame, side: ColumnMapping, money: MoneyFlags) -> Column:
    """Units of a row: weighted where given, else units, else 0; 1 if no units column is mapped."""
    units = F.coalesce(lenient_double(df, side.units), F.lit(0.0)) if side.units else F.lit(1.0)
    if side.weighted:
        units = F.coalesce(lenient_double(df, side.weighted), units)
    return units / 100 if money.implied_units else units


def dollars(df: DataFrame, side: ColumnMapping, money: MoneyFlags) -> Column:
    """Dollars of a row: price scaled first, then multiplied by the effective units when it is a unit price."""
    if not side.price:
        raise ConfigError("dollars need a price column")
    price = F.coalesce(lenient_double(df, side.price), F.lit(0.0))
    if money.implied_dollars:
        price = price / 100
    return price * effective_units(df, side, money) if money.price_type is PriceType.UNIT_PRICE else price


def item_units(df: DataFrame, side: ColumnMapping) -> Column:
    units = F.coalesce(lenient_double(df, side.units), F.lit(0.0))
    return F.coalesce(lenient_double(df, side.weighted), units) if side.weighted else units


def item_dollars(df: DataFrame, side: ColumnMapping, money: MoneyFlags) -> Column:
    """Item dollars: nulls survive the product and become 0 only at the end; implied units are not applied."""
    price = lenient_double(df, side.price)
    if money.price_type is PriceType.UNIT_PRICE:
        units = lenient_double(df, side.units)
        if side.weighted:
            units = F.coalesce(lenient_double(df, side.weighted), units)
        price = price * units
    return F.coalesce(price / 100 if money.implied_dollars else price, F.lit(0.0))


def guarded_pct(diff: Column, base: Column) -> Column:
    """diff as per cent of base, two decimals; -100 where base is 0."""
    return F.when(base != 0, F.round(diff / base * 100, 2)).otherwise(F.lit(-100.0))


def override(name: str, kind: str) -> Column:
    """Cast of a text column for the typed write; what can't be read becomes null."""
    if kind not in OVERRIDE_TYPES:
        raise ConfigError(f"unsupported type {kind!r} for {name!r}")
    c = text(col(name))
    if kind == "Boolean":
        low = F.lower(c)
        return F.when(low.isin(*TRUE_TOKENS), F.lit(True)).when(low.isin(*FALSE_TOKENS), F.lit(False)).alias(name)
    if kind == "Utf8":
        return c.alias(name)
    if kind in ("Float64", "Float32"):
        return F.when(c.rlike(_NUMBER), c.try_cast(OVERRIDE_TYPES[kind])).alias(name)
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast(OVERRIDE_TYPES[kind])).alias(name)


def numeric_like(c: Column) -> Column:
    """Digits once one point and one hyphen are taken out, wherever they stand; blank is not."""
    return F.regexp_replace(F.regexp_replace(c, r"^([^.]*)\.", "$1"), "^([^-]*)-", "$1").rlike(r"^\p{Nd}+$")


def scrub(c: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
