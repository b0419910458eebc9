"""Best representative of each duplicate group: field-by-field survivorship in a single aggregation.

Every attribute takes the maximum of a composite struct (non-null, source priority, date, accession, id, value),
so one pass with partial aggregation before the shuffle decides all fields; a hot key is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_INT = -(1 << 31)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def strip(c: Column) -> Column:
    """White space of every script off both ends (trim() takes the blank only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def fact_key(facts: DataFrame) -> DataFrame:
    """Adds the normalised key k_cik, k_concept, k_unit, k_year; a null or empty part gives no key."""
    number = digits(F.col("cik"))
    padded = F.when(F.length(number) >= 10, number).otherwise(F.lpad(number, 10, "0"))
    return facts.withColumns({
        "k_cik": F.when(number != "", padded),
        "k_concept": strip(F.regexp_replace("concept", r"(?s)^.*:", "")),
        "k_unit": F.upper(strip(F.col("unit"))),
        "k_year": F.col("fiscal_year"),
    })


def end_day(c: Column) -> Column:
    """yyyymmdd of a trimmed text that starts yyyy-MM-dd, or is yyyyMMdd; anything else is none (null)."""
    text = strip(c)
    dashed = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(dashed != "", F.replace(dashed, F.lit("-"), F.lit("")).cast("int")).when(text.rlike(r"^\d{8}"), F.substring(text, 1, 8).cast("int"))


def accession_rank(c: Column) -> Column:
    """Year and sequence of an accession number, the last 8 of exactly 18 digits; otherwise none (null)."""
    number = digits(c)
    return F.when(F.length(number) == 18, F.substring(number, 11, 8).cast("int"))


def survivors(facts: DataFrame) -> DataFrame:
    """One row per fact key with the best record and, for each field, its value and the fact it came from.

    Order within a key: form starting 10-K, later end date (none last), larger accession (none last), larger
    fact_id. Nulls, NaN and blanks never survive while another row has a value; an all-missing field is null with
    origin 0. Rows without a key part or fact_id make no group; repeated rows count once; empty tables give no rows.
    """
    rows = fact_key(facts).where("k_cik is not null and k_concept is not null and k_unit is not null and k_year is not null and fact_id is not null")
    rank = F.struct(
        F.coalesce(F.col("form").startswith("10-K"), F.lit(False)).alias("annual"), F.coalesce(end_day(F.col("end_date")), F.lit(MIN_INT)).alias("day"),
        F.coalesce(accession_rank(F.col("accession_number")), F.lit(MIN_INT)).alias("filing"), F.col("fact_id").alias("id"),
    )
    rows = rows.select("k_cik", "k_concept", "k_unit", "k_year", "fact_id", "value", "entity_name", "accession_number", "end_date", "form", "fiscal_period", rank.alias("rank"))

    def best(has: Column, field: str) -> Column:
        return F.max(F.struct(has.alias("has"), F.col("rank"), F.col(field).alias("v")))

    value = F.col("value").isNotNull() & ~F.isnan("value")
    fields = {
        "value": value, "entity_name": ~blank(F.col("entity_name")), "accession_number": F.col("rank.filing") > MIN_INT,
        "end_date": F.col("rank.day") > MIN_INT, "form": ~blank(F.col("form")), "fiscal_period": ~blank(F.col("fiscal_period")),
    }
    grouped = rows.groupBy("k_cik", "k_concept", "k_unit", "k_year").agg(
        F.min("fact_id").alias("lowest"), F.max("fact_id").alias("highest"), F.max("rank").alias("top"), *[best(has, f).alias(f"b_{f}") for f, has in fields.items()]
    )
    kept = {f: F.when(F.col(f"b_{f}.has"), F.col(f"b_{f}.v")) for f in fields}
    origin = {f: F.when(F.col(f"b_{f}.has"), F.col(f"b_{f}.rank.id")).otherwise(F.lit(0)).cast("bigint") for f in fields}
    return grouped.select(
        F.col("k_cik").alias("cik"), F.col("k_concept").alias("concept"), F.col("k_unit").alias("unit"), F.col("k_year").alias("fiscal_year"), F.col("top.id").alias("fact_id"),
        (F.col("highest") > F.col("lowest")).alias("contested"), *[c.alias(f) for f, c in kept.items()], *[c.alias(f"{f}_fact_id") for f, c in origin.items()],
    )
