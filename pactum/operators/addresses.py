"""Our entity's standard name and its dated address.

The addresses are a dimension with validity periods.  ``as_of_join`` finds the period that
holds on a row's day by an equi-join on the entity with a range condition: a row meets the few
periods of its own entity, never the whole dimension.  Periods are first made disjoint (each
ends the day before the next one begins), so no row is doubled.  Spark broadcasts the dimension
if its size allows, else both sides are shuffled by entity and a hot entity is split by AQE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig

PERIODS = "entity string, valid_from date, valid_to date, address string"
FIRST, LAST = "0001-01-01", "9999-12-31"


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def entity_names(cfg: EngineConfig) -> tuple[str, str, str, str]:
    base = cfg.primary_company_display
    return f"{base} Europe ApS", f"{base} GmbH", f"{base} UK Ltd", f"{base} Corporation"


def address_book(spark: SparkSession, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The configured periods: the home entity moves at ``cfg.address_cutover``; the entities
    abroad share one address.  NULL bounds are open."""
    europe, gmbh, uk, home = entity_names(cfg)
    abroad = "21 Harbour Park, 8700 Horsens"
    rows = [(home, None, cfg.address_cutover - dt.timedelta(days=1), "2560 Old Mill Street, Boulder"),
            (home, cfg.address_cutover, None, "305 New Square, Louisville")]
    return spark.createDataFrame(rows + [(e, None, None, abroad) for e in (europe, gmbh, uk)], PERIODS)


def standard_entity(name: Column, region: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """One of our controlled entity names, by words in the name, then by region."""
    europe, gmbh, uk, home = entity_names(cfg)
    n, word = F.lower(F.coalesce(name, F.lit(""))), cfg.primary_company_names[0].lower()
    emea = F.lower(F.coalesce(region, F.lit(""))).contains("emea")
    return (F.when(n == "", F.lit(home)).when(n.contains("europe") | n.contains("aps") | emea, F.lit(europe))
            .when(n.contains("gmbh") | n.contains("germany"), F.lit(gmbh))
            .when(n.contains("uk") & n.contains(word), F.lit(uk)).otherwise(F.lit(home)))


def disjoint_periods(periods: DataFrame) -> DataFrame:
    """Periods with closed bounds; one that overlaps the next of its entity ends the day before
    it, and of periods that begin together the one that ends last stays."""
    rows = periods.select("entity", F.coalesce("valid_from", _day(FIRST)).alias("valid_from"),
                          F.coalesce("valid_to", _day(LAST)).alias("valid_to"), "address")
    rows = rows.groupBy("entity", "valid_from").agg(F.max(F.struct("valid_to", "address")).alias("p")).select("entity", "valid_from", "p.*")
    following = F.lead("valid_from").over(Window.partitionBy("entity").orderBy("valid_from"))
    rows = rows.withColumn("valid_to", F.least("valid_to", F.coalesce(F.date_sub(following, 1), _day(LAST))))
    return rows.filter("valid_from <= valid_to")


def as_of_join(rows: DataFrame, periods: DataFrame, entity_col: str, day_col: str, out: str = "address") -> DataFrame:
    """``rows`` with the address valid on ``day_col``; a row without a day takes the entity's
    earliest period, one without a period gets NULL."""
    p = disjoint_periods(periods).alias("_p")
    day = F.coalesce(F.col(day_col).cast("date"), _day(FIRST))
    earliest = p.groupBy("entity").agg(F.min("valid_from").alias("_first"))
    p = p.join(earliest, "entity").select(
        F.col("entity").alias("_e"), F.when(F.col("valid_from") == F.col("_first"), _day(FIRST)).otherwise(F.col("valid_from")).alias("_from"),
        F.col("valid_from").alias("_begins"), F.col("valid_to").alias("_to"), F.col("address").alias("_a"))
    inside = (day >= F.col("_from")) & (day <= F.col("_to"))
    # only a missing day reaches back before the first period
    inside &= F.col(day_col).isNull() | (day >= F.col("_begins"))
    return rows.join(p, (F.col(entity_col) == F.col("_e")) & inside, "left").withColumn(out, F.col("_a")).drop("_e", "_from", "_begins", "_to", "_a")


def first_filled(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def party_two(rows: DataFrame, periods: DataFrame, names: list[Column], addresses: list[Column], region: Column, day_col: str,
              cfg: EngineConfig = DEFAULT) -> DataFrame:
    """E29 for the list export: ``rows`` with party2_name (standard entity of the first filled
    name) and party2_address (the first stored one, else the dated one)."""
    default = F.lit(entity_names(cfg)[3])
    out = rows.withColumn("party2_name", standard_entity(F.coalesce(first_filled(*names), default), region, cfg)) \
        .withColumn("_stored", first_filled(*addresses) if addresses else F.lit(None).cast("string"))
    out = as_of_join(out, periods, "party2_name", day_col, "_dated")
    return out.withColumn("party2_address", F.coalesce("_stored", "_dated")).drop("_stored", "_dated")
