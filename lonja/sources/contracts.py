"""What a table must look like: contract-checked writing, once-only migrations, the wide export frame, option groups, and
a cache whose entries end."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Contract:
    """Columns in their order, the key that must be there and unique, and the number of rows if it is fixed."""

    columns: tuple[str, ...]
    key: tuple[str, ...] = ()
    rows: int | None = None
    banned: DataFrame | None = None  # keys that must not occur

    def report(self, df: DataFrame) -> DataFrame:
        """One row: rows, rows without a key, keys that occur more than once; one aggregate over one shuffle of the keys."""
        key = [F.col(k) for k in self.key]
        gap = F.lit(False)
        for k in key:
            gap = gap | k.isNull() | (k.cast("string") == "")
        per = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)], gap.alias("_gap")).agg(F.count("*").alias("n"))
        total = F.coalesce(F.sum("n"), F.lit(0))
        return per.agg(total.alias("rows"), F.coalesce(F.sum(F.when(F.col("_gap"), F.col("n"))), F.lit(0)).alias("keyless"), F.count_if(~F.col("_gap") & (F.col("n") > 1)).alias("repeated_keys"))

    def check(self, df: DataFrame) -> None:
        if tuple(df.columns) != self.columns:
            raise ContractError(f"columns are {df.columns}")
        r = self.report(df).collect()[0]
        if self.rows is not None and r["rows"] != self.rows:
            raise ContractError(f"{r['rows']} rows where {self.rows} are due")
        if self.key and (r.keyless or r.repeated_keys):
            raise ContractError(f"{r.keyless} rows without a key, {r.repeated_keys} keys repeated")
        if self.banned is not None and df.join(self.banned, list(self.key), "left_semi").limit(1).count():
            raise ContractError("keys occur that must not")


def write_checked(df: DataFrame, path: str, contract: Contract) -> None:
    """Writes the frame, reads it back and checks what was written; a table that breaks its contract raises."""
    if tuple(df.columns) != contract.columns:
        raise ContractError(f"columns are {df.columns}")
    df.write.mode("overwrite").parquet(path)
    contract.check(df.sparkSession.read.parquet(path))


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    apply: Callable[[SparkSession], None] = field(compare=False)


def migrate(spark: SparkSession, log_path: str, component: str, migrations: Sequence[Migration]) -> list[int]:
    """Applies the component's migrations in order of version, each once: what is done stands in a table of its own, which
    grows by a row after each. Returns the versions applied now. Repeated versions raise before anything is done."""
    ordered = sorted(migrations, key=lambda m: m.version)
    if len({m.version for m in ordered}) != len(ordered):
        raise ValueError("two migrations have one version")
    schema, now = "component string, version int, name string, applied_at timestamp", []
    spark.createDataFrame([], schema).write.mode("append").parquet(log_path)
    done = {r.version for r in spark.read.schema(schema).parquet(log_path).where(F.col("component") == component).select("version").collect()}
    for m in (m for m in ordered if m.version not in done):
        m.apply(spark)
        spark.range(1).select(F.lit(component).alias("component"), F.lit(m.version).cast("int").alias("version"), F.lit(m.name).alias("name"), F.current_timestamp().alias("applied_at")).write.mode("append").parquet(log_path)
        now.append(m.version)
    return now


# The columns of the wide export frame in their order: name, and the path of the nested listing if it is another.
EXPORT = [
    ("listing_id", ""), ("source", ""), ("url", ""), ("scraped_at", ""), ("title", ""), ("make", ""), ("model", ""), ("vehicle_signature", ""), ("variant_key", ""), ("market_key", ""), ("comparable_match_level", ""),
    ("price_gross_eur", "price_eur"), ("price_net_eur", ""), ("original_price", "price_original.amount"), ("original_currency", "price_original.currency_code"), ("year", "first_registration.year"), ("month", "first_registration.month"),
    ("mileage_km", ""), ("power_hp", ""), ("power_kw", ""), ("engine_displacement_cc", ""), ("fuel_type", ""), ("transmission", ""), ("body_type", ""), ("doors", ""), ("seats", ""), ("color_exterior", ""),
    ("co2_emissions_g_km", ""), ("co2_original_g_km", ""), ("co2_inferred_g_km", ""), ("co2_source_type", ""), ("co2_confidence", ""), ("es_market_avg", ""), ("es_market_median", ""), ("es_market_min", ""), ("es_sample_size", ""),
    ("es_exact_sample_size", ""), ("es_near_sample_size", ""), ("es_broad_sample_size", ""), ("best_break_even", ""), ("potential_margin_avg", ""), ("potential_margin_min", ""), ("opportunity_score", "import_ready_score"),
    ("consumption_combined_l_100km", "consumption_l_100km.combined"), ("consumption_urban_l_100km", "consumption_l_100km.urban"), ("consumption_highway_l_100km", "consumption_l_100km.highway"), ("country_code", "location.country_code"),
    ("region", "location.region"), ("province", "location.province"), ("city", "location.city"), ("postal_code", "location.postal_code"), ("latitude", "location.latitude"), ("longitude", "location.longitude"), ("seller_type", "seller.type"),
    ("seller_name", "seller.name"), ("seller_rating", "seller.rating"), ("seller_rating_count", "seller.rating_count"), ("seller_phone", "seller.phone"), ("seller_email", "seller.email"), ("seller_vat_number", "seller.vat_number"),
    ("seller_dealer_id", "seller.dealer_id"), ("description", ""),
]
EXPORT_METADATA = ["advert_type", "vehicle_id", "environment_badge", "hsn_tsn", "certified", "publish_date", "update_date", "exportable"]


def _path(df: DataFrame, path: str) -> Column | None:
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    c = F.col(path)
    return c.cast("timestamp_ntz") if kind.typeName().startswith("timestamp") else c


def wide_export(df: DataFrame, with_metadata: bool = False) -> DataFrame:
    """The export frame of nested or flat listings: every column of EXPORT, by its path or, in a flat frame, by its own name;
    null where the frame has neither. Times lose their zone. With metadata, eight columns more."""
    paths = [(name, path or name) for name, path in EXPORT] + ([(m, f"metadata.{m}") for m in EXPORT_METADATA] if with_metadata else [])
    pick = lambda name, path: next((c for c in (_path(df, path), _path(df, name)) if c is not None), F.lit(None).cast("string"))
    return df.select(*[pick(name, path).alias(name) for name, path in paths])


# Labels of the option that means all.
ALL_LABELS = ["todo", "all", "alle", "beliebig"]
_OPTION = "struct<value:string,label:string,isGroup:boolean,optgroupLabel:string,items:array<string>>"


def option_models(options: DataFrame, json: str = "options", make: str = "make_id", depth: int = 4, excluded: tuple[int, ...] = ()) -> DataFrame:
    """make_id, id, name of the models in nested option groups: groups opened level by level down to `depth`, the option for
    all, groups themselves and options without a number left out; each make once, and `excluded` makes not at all. Deeper
    groups raise."""
    df = options.where(~F.col(make).isin(*excluded)) if excluded else options
    level = df.groupBy(make).agg(F.min(json).alias("j")).select(F.col(make).alias("make_id"), F.explode(F.from_json("j", "array<string>")).alias("o"))
    out = None
    for i in range(depth):
        x = level.select("make_id", F.from_json("o", _OPTION).alias("x"))
        group = F.col("x.items").isNotNull() | F.col("x.optgroupLabel").isNotNull()
        own = x.where(~group & ~F.coalesce("x.isGroup", F.lit(False)) & (F.coalesce("x.value", F.lit("")) != "") & ~F.lower(F.trim("x.label")).isin(*ALL_LABELS))
        own = own.select("make_id", F.col("x.value").try_cast("int").alias("id"), F.trim("x.label").alias("name")).where("id is not null")
        out = own if out is None else out.unionByName(own)
        level = x.where(group).select("make_id", F.explode("x.items").alias("o")) if i < depth - 1 else x.where(group & (F.size("x.items") > 0))
    deeper = level.select(F.raise_error(F.lit("option groups are nested deeper than expected")).cast("int").alias("make_id"), F.lit(0).alias("id"), F.lit("").alias("name"))
    return out.unionByName(deeper)


class TtlCache:
    """Results by key that end after `ttl` seconds. One caller computes a missing result, others wait for it and take it."""

    def __init__(self, ttl: float = 900.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.held, self.locks, self.lock = ttl, clock, {}, {}, Lock()

    def _fresh(self, key: Hashable):
        hit = self.held.get(key)
        return hit if hit is not None and self.clock() - hit[0] < self.ttl else None

    def get(self, key: Hashable, compute: Callable[[], object]):
        if (hit := self._fresh(key)) is not None:
            return hit[1]
        with self.lock:
            own = self.locks.setdefault(key, Lock())
        with own:
            if (hit := self._fresh(key)) is not None:
                return hit[1]
            value = compute()
            if isinstance(value, DataFrame):
                value = value.persist()
            if key in self.held and isinstance(self.held[key][1], DataFrame):
                self.held[key][1].unpersist()
            self.held[key] = (self.clock(), value)
            return value
