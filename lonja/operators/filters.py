"""The unified listing filter as a dataclass that compiles to one predicate, and its validation."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.keys import TRANSMISSIONS, effective_year, fuel_category
from lonja.functions.text import contains_tokens, normal_word, normalize_text


@dataclass(frozen=True)
class ListingFilter:
    """Every set field is a condition; all must hold. Ranges are closed, and a null value fails a requested range."""

    make: str | None = None
    model: str | None = None
    version: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_year: int | None = None
    max_year: int | None = None
    min_km: int | None = None
    max_km: int | None = None
    min_hp: int | None = None
    max_hp: int | None = None
    fuels: tuple[str, ...] = ()
    transmissions: tuple[str, ...] = ()
    bodies: tuple[str, ...] = ()
    min_doors: int | None = None
    max_doors: int | None = None
    min_seats: int | None = None
    max_seats: int | None = None
    country: str | None = None
    dealer_only: bool = False
    private_only: bool = False
    with_images: bool = False
    certified_only: bool = False
    page_size: int = 30

    def __post_init__(self) -> None:
        for name in ("price", "year", "km", "hp", "doors", "seats"):
            lo, hi = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            if lo is not None and hi is not None and lo > hi:
                raise ValueError(f"min_{name} exceeds max_{name}")
        for name, low, high in (("year", 1900, 2030), ("doors", 2, 5), ("seats", 2, 9)):
            for side in ("min", "max"):
                v = getattr(self, f"{side}_{name}")
                if v is not None and not low <= v <= high:
                    raise ValueError(f"{side}_{name} is outside {low} to {high}")
        if not 1 <= self.page_size <= 200:
            raise ValueError("page_size is outside 1 to 200")
        if self.dealer_only and self.private_only:
            raise ValueError("dealer_only and private_only exclude each other")

    def predicate(self, df: DataFrame) -> Column:
        """The condition over a frame of listings; columns the frame lacks count as null."""
        col = lambda n: F.col(n) if n in df.columns else F.lit(None)
        out = F.lit(True)
        if self.make:
            out = out & (normalize_text(col("make")) == normalize_text(F.lit(self.make)))
        for needle, places in ((self.model, ("model", "title")), (self.version, ("version", "title"))):
            if needle:
                n = normalize_text(F.lit(needle))
                out = out & (contains_tokens(normalize_text(col(places[0])), n) | contains_tokens(normalize_text(col(places[1])), n))
        ranges = (("price", col("price_eur")), ("year", effective_year(df)), ("km", col("mileage_km")), ("hp", col("power_hp")), ("doors", col("doors")), ("seats", col("seats")))
        for name, c in ranges:
            lo, hi = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            if lo is not None:
                out = out & F.coalesce(c >= lo, F.lit(False))
            if hi is not None:
                out = out & F.coalesce(c <= hi, F.lit(False))
        if self.fuels:
            out = out & fuel_category(col("fuel_type")).isin(*self.fuels)
        if self.transmissions:
            out = out & normalize_text(col("transmission")).isin(*[w for t in self.transmissions for w in TRANSMISSIONS.get(t, [t])])
        if self.bodies:
            out = out & normalize_text(col("body_type")).isin(*self.bodies)
        if self.country:
            out = out & (normalize_text(col("country_code")) == normalize_text(F.lit(self.country)))
        if self.dealer_only:
            out = out & (normalize_text(col("seller_type")) == "dealer")
        if self.private_only:
            out = out & (normalize_text(col("seller_type")) == "private")
        if self.with_images:
            out = out & F.coalesce(F.size(col("images")) > 0, F.lit(False))
        if self.certified_only:
            out = out & F.coalesce(col("certified"), F.lit(False))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(df))

    def same_vehicle(self, other: "ListingFilter") -> bool:
        """Whether two filters ask for the same vehicle, names compared as normalised text; price, country, seller and the
        size of a page may differ."""
        free = {"min_price", "max_price", "country", "dealer_only", "private_only", "with_images", "certified_only", "page_size"}
        fold = lambda v: normal_word(v) if isinstance(v, str) else frozenset(v) if isinstance(v, tuple) else v
        blank = {"make", "model", "version"}
        side = lambda f, n: fold(getattr(f, n) or "") if n in blank else fold(getattr(f, n))
        return all(side(self, f.name) == side(other, f.name) for f in fields(self) if f.name not in free)
