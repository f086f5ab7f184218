"""What match documents say: facts, goals, metrics and narratives as tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import sanitise
from heddle.operators.evidence import check_providers

SCHEMA = """match_id string, competition string, stage string, `date` string, venue string, teams struct<home: string, away: string>,
 score struct<full_time: string, after_extra_time: string, penalties: string, winner: string>, fact_source_ids array<string>,
 goals array<struct<team: string, player: string, minute: int, detail: string, evidence_id: string>>,
 evidence array<struct<id: string, claim: string, value: string, source_url: string, source_tier: string, provider: string>>,
 metrics struct<provider: string, retrieved_at: string, team_metrics: map<string, map<string, struct<label: string, value: string, unit: string, evidence_id: string>>>>,
 narratives array<struct<narrative: string, source_type: string, evidence_id: string, verification_status: string>>"""


def evidence(documents: DataFrame) -> DataFrame:
    """(match_id, id, claim, value, url, declared, provider_id) of each item of evidence."""
    e = documents.select("match_id", F.explode("evidence").alias("e"))
    return e.select("match_id", "e.id", "e.claim", "e.value", F.col("e.source_url").alias("url"), F.col("e.source_tier").alias("declared"), F.col("e.provider").alias("provider_id"))


def facts(documents: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, refused): the facts of matches all of whose evidence is of known providers (provider_id, tier, domains), of their tier and from their
    domains; and of the others (match_id, id, reason) of each item that isn't. One such item refuses its match."""
    checked = check_providers(evidence(documents), providers, declared="declared")
    refused = checked.where(F.col("reason").isNotNull()).select("match_id", "id", "reason")
    good = documents.join(refused.select("match_id").distinct(), "match_id", "left_anti")
    return good.select("match_id", "competition", "stage", F.col("date").alias("day"), "venue", "teams.home", "teams.away", "score.*", F.col("fact_source_ids").alias("source_ids")), refused


def goals(documents: DataFrame) -> DataFrame:
    """(match_id, position, team, player, minute, detail, evidence_id)."""
    return documents.select("match_id", F.posexplode("goals").alias("position", "g")).select("match_id", "position", "g.*")


def metrics(documents: DataFrame) -> DataFrame:
    """(match_id, provider, team, metric, label, value, unit, evidence_id); a match without metrics has no rows, a missing unit is empty."""
    teams = documents.where(F.col("metrics").isNotNull()).select("match_id", "metrics.provider", F.explode("metrics.team_metrics").alias("team", "values"))
    each = teams.select("match_id", "provider", "team", F.explode("values").alias("metric", "m"))
    return each.select("match_id", "provider", "team", "metric", "m.label", "m.value", F.coalesce("m.unit", F.lit("")).alias("unit"), "m.evidence_id")


def narratives(documents: DataFrame) -> DataFrame:
    """(match_id, position, narrative, source_type, evidence_id, verification_status): texts from outside are sanitised; without a status they are narratives only."""
    each = documents.select("match_id", F.posexplode("narratives").alias("position", "n"))
    return each.select("match_id", "position", sanitise(F.col("n.narrative")).alias("narrative"), "n.source_type", "n.evidence_id", F.coalesce("n.verification_status", F.lit("narrative_only")).alias("verification_status"))
