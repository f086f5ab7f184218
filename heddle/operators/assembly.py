"""Assembly of packages: slide specs, panels, gates, rescues, preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.fixed import FAIR_USE, QUOTES
from heddle.functions.text import banned_hits, json_object, mentions_score, scores
from heddle.functions.urls import hints_report, mentions_final_score
from heddle.operators.rules import NONE


def domain_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://(?:www\.)?([^/:?#]+)", 1)


def display_date(day: Column) -> Column:
    """dd.MM.yyyy of an ISO date, else the text itself, empty for null."""
    d = F.coalesce(day, F.lit(""))
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat_ws(".", F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4))).otherwise(d)


def display_score(score: Column) -> Column:
    return F.replace(F.coalesce(score, F.lit("")), F.lit("-"), F.lit("–"))


def capitalised(text: Column) -> Column:
    """First letter in upper case, unless the second one is."""
    second = F.substring(text, 2, 1)
    keep = (second != F.lower(second)) & (second == F.upper(second))
    return F.when(keep, text).otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)))


def title_question(headline: Column, home: Column, away: Column) -> Column:
    """The headline without the score: after "home 2-1 away." or after a prefix with a number and a
    team before a colon; else as it is."""
    tail = F.regexp_extract(headline, r"(?s)^\s*(.+?)\s+\d{1,2}\s*[-:–]\s*\d{1,2}\s+(.+?)\s*\.\s*(.+)$", 3)
    first = F.regexp_extract(headline, r"(?s)^\s*(.+?)\s+\d{1,2}\s*[-:–]\s*\d{1,2}\s+(.+?)\s*\.\s*(.+)$", 1)
    second = F.regexp_extract(headline, r"(?s)^\s*(.+?)\s+\d{1,2}\s*[-:–]\s*\d{1,2}\s+(.+?)\s*\.\s*(.+)$", 2)
    scored = (tail != "") & (F.lower(first) == F.lower(home)) & (F.lower(second) == F.lower(away)) & (home != "") & (away != "")
    prefix, rest = F.regexp_extract(headline, r"(?s)^([^:]*):(.*)$", 1), F.btrim(F.regexp_extract(headline, r"(?s)^([^:]*):(.*)$", 2))
    team = ((home != "") & F.contains(F.lower(prefix), F.lower(home))) | ((away != "") & F.contains(F.lower(prefix), F.lower(away)))
    return F.when(scored, capitalised(F.btrim(tail))).when(prefix.rlike("[0-9]") & team & (rest != ""), capitalised(rest)).otherwise(headline)


def slide_specs(slides: DataFrame, quotes: DataFrame, match: DataFrame, entity: str) -> DataFrame:
    """One row a slide (entity, slide, role, headline, claim_id) with what its role shows, from the
    package's match (entity, home, away, score, day) and quotes (entity, claim_id, outlet, country, url)."""
    total = F.count("*").over(Window.partitionBy(entity))
    rows = slides.withColumn("total", total).join(match, entity, "left")
    first = quotes.groupBy(entity, "claim_id").agg(F.min_by(F.struct("outlet", "country", "url"), "url").alias("q"))
    rows = rows.join(first, [entity, "claim_id"], "left")
    is_title, is_quote = F.col("role") == "title", F.col("role") == "media_country"
    return rows.select(
        entity, "slide", "role", "total",
        F.when(is_title, title_question(F.col("headline"), F.col("home"), F.col("away"))).alias("question"),
        F.when(is_title, display_score(F.col("score"))).alias("score"),
        F.when(is_title | (F.col("role") == "sources"), display_date(F.col("day"))).alias("day"),
        F.when(is_quote, F.col("q.outlet")).alias("outlet"),
        F.when(is_quote, domain_of(F.col("q.url"))).alias("domain"),
        F.when(is_quote, F.when(F.col("q.country").eqNullSafe(F.col("home")), "home").otherwise("away")).alias("accent"),
    )


def passes_gate(score: Column, url: Column, title: Column, text: Column, verdict: Column) -> Column:
    """Whether a hit is kept: a report or the final score in the slug, no text, or no verdict keep
    it; else the verdict decides."""
    return hints_report(url, title) | mentions_final_score(score, url, title) | (F.btrim(F.coalesce(text, F.lit(""))) == "") | F.coalesce(verdict, F.lit(True))


def rescued(rows: DataFrame, group: str, chosen: str, own: str, seq: str, slots: int = QUOTES) -> DataFrame:
    """Order of a pick: its own-voice hits, then as many own-voice ones of the pool as slots are
    missing, then the others. Hits that are neither picked nor added are left out."""
    rows = rows.withColumn("__kind", F.when(F.col(chosen) & F.col(own), 0).when(~F.col(chosen) & F.col(own), 1).when(F.col(chosen), 2))
    good = F.count_if(F.col("__kind") == 0).over(Window.partitionBy(group))
    others = F.count_if(F.col("__kind") == 2).over(Window.partitionBy(group))
    nth = F.row_number().over(Window.partitionBy(group, "__kind").orderBy(seq))
    rows = rows.withColumns({"__good": good, "__others": others, "__nth": nth}).where("__kind is not null")
    rows = rows.where((F.col("__kind") != 1) | ((F.col("__others") > 0) & (F.col("__nth") <= slots - F.col("__good"))))
    place = F.row_number().over(Window.partitionBy(group).orderBy("__kind", seq)).cast("long")
    return rows.withColumn("place", place).drop("__kind", "__good", "__others", "__nth")


def salvaged(attempts: DataFrame, entity: str, seq: str, raw: str) -> DataFrame:
    """The newest attempt of each entity that is a JSON object."""
    good = attempts.withColumn("__json", json_object(F.col(raw))).where("__json is not null")
    return good.groupBy(entity).agg(F.max(seq).alias(seq), F.max_by("__json", seq).alias("json"))


def panel(quotes: DataFrame, entity: str, seq: str, evidence_id: str, translation: Column, allowed: Column, banned: tuple[str, ...], limit: int = 400) -> DataFrame:
    """(entity, source_count, ids, has_mood): of the first quotes, cut before they are checked, those
    that are known, new, translated, short and clean; a mood needs two."""
    nth = F.row_number().over(Window.partitionBy(entity).orderBy(seq))
    text = F.btrim(F.coalesce(translation, F.lit("")))
    rows = quotes.withColumns({"__nth": nth, "__text": text, "__ok": F.coalesce(allowed, F.lit(False))}).where(F.col("__nth") <= QUOTES)
    again = F.row_number().over(Window.partitionBy(entity, evidence_id).orderBy(seq)) > 1
    good = F.col("__ok") & ~F.col("__again") & (F.col("__text") != "") & (F.length("__text") <= limit) & (F.size(banned_hits(F.col("__text"), banned)) == 0)
    rows = rows.withColumn("__again", again).withColumn("__good", good)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__good"), F.struct(seq, evidence_id)))), lambda s: s[evidence_id].cast("string")), ",")
    counted = rows.groupBy(entity).agg(F.count_if("__good").alias("source_count"), ids.alias("ids"))
    return counted.withColumn("has_mood", F.col("source_count") >= 2)


def score_consistent(texts: DataFrame, entity: str, text: str, home: Column, away: Column) -> DataFrame:
    """(entity, consistent): no text of the entity has a score, or one has the final one."""
    each = texts.withColumn("__s", scores(F.col(text)))
    return each.groupBy(entity).agg((~F.bool_or(F.size("__s") > 0) | F.bool_or(mentions_score(F.col("__s"), home, away))).alias("consistent"))


def preflight(matches: DataFrame, references: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, failures): a match (home, away, score) with what would stop a run: no teams, the same
    team twice, no score, no evidence, references (key, kind, id) to evidence (key, id) that isn't there."""
    dangling = references.join(evidence.select(key, "id").distinct(), [key, "id"], "left_anti").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "id"))), ",").alias("__dangling"))
    counted = evidence.groupBy(key).agg(F.count_distinct("id").alias("__n"))
    rows = matches.join(dangling, key, "left").join(counted, key, "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    names = F.array(
        F.when(blank("home") | blank("away"), "no_teams").when(F.col("home") == F.col("away"), "same_team"), F.when(blank("score"), "no_score"), F.when(F.col("__n").isNull(), "no_evidence"),
        F.when(F.col("__dangling").isNotNull(), F.concat(F.lit("dangling "), "__dangling")),
    )
    return rows.select(key, F.array_join(F.array_compact(names), ";").alias("failures"))


def operator_facts(requests: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """(key, status, home, away, tier, confidence) of scores that an operator gives: the first two
    names of the request (key, name, position), tier C and low confidence; fewer are not enough."""
    named = mentions.where("position <= 2").groupBy(key).agg(F.min_by("name", "position").alias("home"), F.max_by("name", "position").alias("away"), F.count("*").alias("n")).where("n = 2")
    rows = requests.select(key).join(named, key, "left")
    found = F.col("n").isNotNull()
    return rows.select(key, F.when(~found, NONE).alias("status"), "home", "away", F.when(found, "C").alias("tier"), F.when(found, "low").alias("confidence"))


def hashtag_names(team_names: Column, english: Column) -> Column:
    """The English name, then the local ones after the first two."""
    local = F.slice(team_names, 3, 1000)
    return F.when(F.coalesce(english, F.lit("")) != "", F.concat(F.array(english), local)).otherwise(local)


def renderable(status: Column, with_review: bool = False) -> Column:
    return (status == "ready") | ((status == "needs_human_review") if with_review else F.lit(False))
