"""A register of organisations: what of it lies in which countries, and its look-up tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marula.functions import text as T


def in_countries(register: DataFrame, codes: Sequence[str]) -> DataFrame:
    """The organisations with a place in any of the countries, whole. register: id, countries (array of codes), and more."""
    return register.where(F.arrays_overlap("countries", F.array(*map(F.lit, codes))))


def country_counts(register: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Rows (country_code, n), most first: organisations of each of the countries, none as 0; one in several counts once for each."""
    each = register.select("id", F.explode(F.array_distinct("countries")).alias("country_code")).groupBy("country_code").agg(F.count("*").alias("k"))
    asked = register.sparkSession.createDataFrame([(c,) for c in codes], "country_code string")
    return asked.join(each, "country_code", "left").select("country_code", F.coalesce("k", F.lit(0)).alias("n")).orderBy(F.desc("n"), "country_code")


def exact_lookup(register: DataFrame) -> DataFrame:
    """Rows (form, id): names other than acronyms in the form of exact look-ups; of several organisations the first in order holds.

    register: ord, id, names (array of structs with value and types).
    """
    n = register.select("ord", "id", F.posexplode("names").alias("at", "n")).where(~F.array_contains("n.types", "acronym"))
    n = n.select("ord", "at", "id", T.exact_name(F.col("n.value")).alias("form")).where("form <> ''")
    return n.groupBy("form").agg(F.min_by("id", F.struct("ord", "at")).alias("id"))


def acronym_lookup(register: DataFrame) -> DataFrame:
    """Rows (country_code, acronym, id): acronyms by country; of several organisations the last in order holds."""
    n = register.select("ord", "id", F.explode("countries").alias("country_code"), "names").select("ord", "id", "country_code", F.posexplode("names").alias("at", "n"))
    n = n.where(F.array_contains("n.types", "acronym"))
    return n.groupBy("country_code", F.col("n.value").alias("acronym")).agg(F.max_by("id", F.struct("ord", "at")).alias("id"))


def metadata(register: DataFrame) -> DataFrame:
    """Rows (id, display, countries): the name to show, or else the first, or else the id."""
    shown = F.filter("names", lambda n: F.array_contains(n["types"], "ror_display"))
    return register.select("id", F.coalesce(F.get(shown, F.lit(0))["value"], F.get("names", F.lit(0))["value"], "id").alias("display"), "countries")
