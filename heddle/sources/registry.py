"""Dimension loaders: a strict source registry, a lenient schedule, match documents, runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEDULE = "competition string, matches array<struct<`date`: string, home: string, away: string, city: string, stadium: string, stage: string>>"
# Tiers of media outlets, their confidence.
TIERS, CONFIDENCE = ("A", "B", "C"), ("high", "medium")
# Infrastructure providers with tier, capabilities, mode, domains.
INFRASTRUCTURE = (
    ("OfflineVerifiedFixture", "A", ["resolve", "facts"], "fixture", []),
    ("OfflineMetricFixture", "B", ["metrics"], "fixture", []),
    ("OfflineNarrativeFixture", "C", ["narratives"], "fixture", []),
    ("OfficialMatchApi", "A", ["resolve", "facts"], "api", ["fifa.com", "uefa.com"]),
    ("LicensedStatsApi", "B", ["metrics"], "api", []),
    ("SearchApiNarratives", "C", ["narratives"], "research", []),
)


class RegistryError(ValueError):
    """The registry can't be used; its message names what is wrong."""


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(countries, outlets) of a registry file, checked. Everything wrong raises RegistryError."""
    try:
        raw = spark.read.option("multiLine", True).json(path)
    except AnalysisException as error:
        raise RegistryError(f"no registry at {path}") from error
    return registry(raw)


def registry(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(countries, outlets) from rows with an array ``countries``."""
    if "countries" not in raw.columns:
        raise RegistryError("no countries")
    c = raw.select(F.explode("countries").alias("c")).select("c.*")
    for name in ("country", "language", "outlets"):
        if name not in c.columns:
            raise RegistryError(f"no {name}")
    o = c.select("country", F.col("language").alias("__language"), F.explode("outlets").alias("o")).select("country", "__language", "o.*")
    for name in ("provider_id", "name", "tier", "domains"):
        if name not in o.columns:
            raise RegistryError(f"no {name}")
    text = lambda d, n, default: F.coalesce(F.col(n), default) if n in d.columns else default
    countries = c.select("country", "language", F.size("outlets").alias("n_outlets"))
    outlets = o.select("country", "provider_id", "name", "tier", "domains", text(o, "confidence", F.lit("high")).alias("confidence"), text(o, "language", F.col("__language")).alias("language"))
    blank = lambda n: F.coalesce(F.btrim(n), F.lit("")) == ""
    of_countries = countries.agg(F.count("*").alias("n"), F.count_distinct("country").alias("different"), F.count_if(blank("country") | blank("language")).alias("blank"), F.count_if(F.coalesce(F.col("n_outlets") < 1, F.lit(True))).alias("bare")).first()
    of_outlets = outlets.agg(
        F.count("*").alias("n"), F.count_distinct("provider_id").alias("different"), F.count_if(blank("provider_id") | blank("name")).alias("blank"), F.count_if(~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False))).alias("tier"),
        F.count_if(~F.col("confidence").isin(*CONFIDENCE)).alias("confidence"), F.count_if(F.coalesce(F.size("domains") < 1, F.lit(True))).alias("domains"), F.count_if(F.col("provider_id").isin(*(x[0] for x in INFRASTRUCTURE))).alias("reserved"),
    ).first()
    problems = {
        "no countries": of_countries["n"] == 0, "a country twice": of_countries["n"] != of_countries["different"], "a blank country": of_countries["blank"], "a country without outlets": of_countries["bare"],
        "a provider twice": of_outlets["n"] != of_outlets["different"], "a blank provider": of_outlets["blank"], "a bad tier": of_outlets["tier"], "a bad confidence": of_outlets["confidence"], "an outlet without domains": of_outlets["domains"],
        "a reserved provider": of_outlets["reserved"],
    }
    found = [k for k, v in problems.items() if v]
    if found:
        raise RegistryError("; ".join(found))
    return countries, outlets


def infrastructure(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INFRASTRUCTURE), "provider_id string, tier string, capabilities array<string>, mode string, domains array<string>")


def providers_with(providers: DataFrame, capability: str) -> DataFrame:
    return providers.where(F.array_contains("capabilities", capability)).orderBy("tier", "provider_id")


# Purposes and the capability that each asks for.
PURPOSES = {"facts": "facts", "metrics": "metrics", "narratives": "narratives", "resolve": "resolve", "media_reaction": "media_reaction"}


def trusted_for(asked: DataFrame, providers: DataFrame) -> DataFrame:
    """Rows (provider_id, purpose) with ``trusted``: the provider is known and can do what the purpose asks for."""
    capability = F.create_map(*(F.lit(x) for pair in PURPOSES.items() for x in pair))[F.col("purpose")]
    can = providers.select("provider_id", F.explode("capabilities").alias("__can")).distinct()
    joined = asked.withColumn("__asked", capability).join(can, (asked["provider_id"] == can["provider_id"]) & (F.col("__asked") == F.col("__can")), "left")
    return joined.select(*(asked[c] for c in asked.columns), F.col("__can").isNotNull().alias("trusted"))


def media_countries(providers: DataFrame) -> DataFrame:
    """The countries of providers (country, capabilities) that can be asked for reactions."""
    return providers.where(F.col("country").isNotNull() & F.array_contains("capabilities", PURPOSES["media_reaction"])).select("country").distinct()


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(competition, day, home, away, venue, stage); rows without day, home or away are left out,
    and a file that is missing or can't be read gives no rows."""
    empty = spark.createDataFrame([], "competition string, day string, home string, away string, venue string, stage string")
    try:
        raw = spark.read.option("multiLine", True).schema(SCHEDULE).json(path)
        rows = raw.select("competition", F.explode("matches").alias("m"))
        venue = F.concat_ws(", ", F.nullif(F.col("m.stadium"), F.lit("")), F.nullif(F.col("m.city"), F.lit("")))
        rows = rows.select("competition", F.col("m.date").alias("day"), "m.home", "m.away", venue.alias("venue"), "m.stage")
        return rows.where((F.coalesce("day", F.lit("")) != "") & (F.coalesce("home", F.lit("")) != "") & (F.coalesce("away", F.lit("")) != ""))
    except AnalysisException:
        return empty


def read_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All match documents of a folder with their file's name; Spark skips names with an underscore."""
    return spark.read.option("multiLine", True).json(folder).withColumn("file", F.col("_metadata.file_name"))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Archived runs, one file a folder; files that can't be read are skipped."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "run*.json").option("recursiveFileLookup", True).json(folder)
    return raw.where("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in raw.columns else raw


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy().agg(F.max_by(F.struct(*runs.columns), "run_id").alias("r")).select("r.*").where("run_id is not null")


def lookup_map(spark: SparkSession, path: str, key: str, value: str, pattern: str | None = None) -> DataFrame:
    """(key, value) of a JSON lines map; rows whose value doesn't match are left out; none without a file."""
    try:
        rows = spark.read.schema(f"{key} string, {value} string").json(path)
        return rows.where(F.col(value).rlike(pattern)) if pattern else rows
    except AnalysisException:
        return spark.createDataFrame([], f"{key} string, {value} string")
