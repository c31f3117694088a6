"""Event cleaning and per-key de-duplication (first / latest row wins).

All three keep-one-row rules are ``row_number() = 1`` filters.  Spark plans
them with a partial WindowGroupLimit before the shuffle, so a key with a huge
number of copies is cut to one row per map task before it is exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window, functions as F

from sessionlens.schema import EVENT_KEY, SRC_ORDER


def _src_order(df: DataFrame) -> list:
    return [F.col(SRC_ORDER)] if SRC_ORDER in df.columns else [F.lit(0)]


def fill_country(events: DataFrame, value: str = "Unknown") -> DataFrame:
    return events.withColumn("country", F.coalesce(F.col("country"), F.lit(value)))


def drop_incomplete_events(events: DataFrame) -> DataFrame:
    return events.na.drop(subset=["user_id", "ga_session_id", "type", "date", "item_id"])


def dedup_events(events: DataFrame) -> DataFrame:
    """Keep the first row (source order) of every (user, session, item, date, type)."""
    w = Window.partitionBy(*EVENT_KEY).orderBy(*_src_order(events))
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


@dataclass
class DedupReport:
    """Rows before/after de-duplication, filled in by the first action on the cleaned events.

    Collected with Spark observations (metrics of the running job), so
    reporting the count costs no extra job.
    """

    before: Observation = field(default_factory=lambda: Observation("dedup_before"))
    after: Observation = field(default_factory=lambda: Observation("dedup_after"))

    @property
    def removed(self) -> int:
        return int(self.before.get["n"]) - int(self.after.get["n"])


def clean_events(events: DataFrame, report: DedupReport | None = None) -> DataFrame:
    """Typed events -> country filled, incomplete rows dropped, key duplicates removed."""
    kept = drop_incomplete_events(fill_country(events))
    if report is not None:
        kept = kept.observe(report.before, F.count(F.lit(1)).alias("n"))
    out = dedup_events(kept)
    if report is not None:
        out = out.observe(report.after, F.count(F.lit(1)).alias("n"))
    return out


def first_per_id(items: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the first row per id in source order."""
    w = Window.partitionBy(id_col).orderBy(*_src_order(items))
    return items.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_per_id(users: DataFrame, id_col: str = "id", date_col: str = "date") -> DataFrame:
    """Keep the latest row per id; a null date counts as latest, then last in source order."""
    order = [F.col(date_col).desc_nulls_first()] + [c.desc() for c in _src_order(users)]
    w = Window.partitionBy(id_col).orderBy(*order)
    return users.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
