"""Driver-side configuration records. They only build column expressions; no data passes through them."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class ConfigError(ValueError):
    """A configuration that cannot be run."""


class PriceType(str, Enum):
    TOTAL_PRICE = "total_price"
    UNIT_PRICE = "unit_price"


class UnitsType(str, Enum):
    QTY = "qty"
    WEIGHT = "weight"


@dataclass(frozen=True)
class ColumnMapping:
    """Role to column name, for one side."""

    store: str | None = None
    units: str | None = None
    price: str | None = None
    weighted: str | None = None
    upc: str | None = None
    desc: str | None = None
    units_type: UnitsType = UnitsType.QTY

    def missing(self, roles: tuple[str, ...]) -> list[str]:
        return [r for r in roles if not getattr(self, r)]


#: Roles that each analysis needs on both sides.
REQUIRED = {"store": ("store", "units", "price"), "sales": ("store",), "upc": ("upc", "desc", "units", "price")}


@dataclass(frozen=True)
class MoneyFlags:
    """How one side writes its money: price of a unit or of the line, cents or dollars, hundredths of units."""

    price_type: PriceType = PriceType.TOTAL_PRICE
    implied_dollars: bool = False
    implied_units: bool = False


@dataclass(frozen=True)
class ValidationConfig:
    bau: ColumnMapping = field(default_factory=ColumnMapping)
    test: ColumnMapping = field(default_factory=ColumnMapping)
    bau_money: MoneyFlags = field(default_factory=MoneyFlags)
    test_money: MoneyFlags = field(default_factory=MoneyFlags)
    store_analysis: bool = False
    sales_analysis: bool = False
    upc_analysis: bool = False

    def enabled(self) -> list[str]:
        flags = (("store", self.store_analysis), ("sales", self.sales_analysis), ("upc", self.upc_analysis))
        return [name for name, on in flags if on]

    def missing_columns(self) -> dict[str, list[str]]:
        out = {}
        for name in self.enabled():
            gone = [f"{side}.{r}" for side in ("bau", "test") for r in getattr(self, side).missing(REQUIRED[name])]
            if gone:
                out[name] = gone
        return out

    def validate(self) -> None:
        if gone := self.missing_columns():
            raise ConfigError(f"validation config incomplete: {gone}")


@dataclass(frozen=True)
class ItemConfig:
    bau: ColumnMapping
    test: ColumnMapping
    bau_money: MoneyFlags = field(default_factory=MoneyFlags)
    test_money: MoneyFlags = field(default_factory=MoneyFlags)
    units_type: UnitsType = UnitsType.QTY

    def validate(self) -> None:
        gone = [f"{s}.{r}" for s in ("bau", "test") for r in getattr(self, s).missing(("upc", "desc", "units", "price"))]
        if gone:
            raise ConfigError(f"item config incomplete: {gone}")


@dataclass(frozen=True)
class FieldSpec:
    """One fixed-width field: 0-based, end exclusive."""

    name: str
    start: int
    end: int

    def __post_init__(self):
        if not self.name or self.start < 0 or self.end <= self.start:
            raise ConfigError(f"bad field {self.name!r} [{self.start}, {self.end})")


@dataclass(frozen=True)
class Layout:
    fields: tuple[FieldSpec, ...]

    def __post_init__(self):
        if not self.fields:
            raise ConfigError("layout has no fields")
        ordered = tuple(sorted(self.fields, key=lambda f: f.start))
        object.__setattr__(self, "fields", ordered)
        for a, b in zip(ordered, ordered[1:]):
            if b.start < a.end:
                raise ConfigError(f"fields {a.name} and {b.name} overlap")

    @property
    def width(self) -> int:
        return max(f.end for f in self.fields)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass(frozen=True)
class ParseConfig:
    """What the parser needs; exactly one of delimiter (delimited) and layout (fixed width) is set."""

    columns: tuple[str, ...] = ()
    delimiter: str | None = None
    layout: Layout | None = None
    header: bool = True
    encoding: str = "utf-8"
    skip_rows: int = 0
    overrides: dict[str, str] = field(default_factory=dict)

    def validate(self) -> None:
        if (self.delimiter is None) == (self.layout is None):
            raise ConfigError("exactly one of delimiter and layout is needed")
        if self.delimiter is not None and len(self.delimiter) != 1:
            raise ConfigError("the delimiter must be one character")
        if self.delimiter is not None and not self.columns:
            raise ConfigError("a delimited file needs column names")
        if self.skip_rows < 0:
            raise ConfigError("skip_rows must not be negative")
