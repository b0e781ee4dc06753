"""Totals over trailing periods, kept as a versioned daily state.

State of an entity on day D and window w: total and count of the days D-w+1..D. The state of D is
the state of D-1 plus the arrivals of D minus what expires, the amounts of day D-w. Three forms:

* ``rolling_state`` back-fills all days at once. Arrivals and expiries become signed day entries;
  their running sum per entity *is* the day-by-day state, so one shuffle on the entity replaces a
  loop over days. Rows are runs of days with constant state (``day_from``..``day_to``), which keeps
  idle days at no cost; ``expand_days`` makes one row per entity and day.
* ``advance_day`` is the daily job: yesterday's state joined with today's arrivals and the
  expiring day's amounts of each window.
* ``correct_state`` recomputes only the days that a late or changed amount can reach and writes
  them with a higher version; ``latest_version`` reads the valid rows.

``maintain_state`` runs all three: a back-fill up to some days before the end, one ``advance_day``
per remaining day, and corrections by what was delivered since. A ``VersionedState`` is what the
queries read.

Amounts are whole cents, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import Scratch

WINDOWS = (7, 30)


def daily_totals(df: DataFrame, entity: str, day: str, amount_cents: str) -> DataFrame:
    """``(entity, day_no, cents, n)`` per entity and day; rows with a NULL entity, day or amount are left out."""
    kept = df.filter(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(amount_cents).isNotNull())
    return kept.groupBy(F.col(entity).alias("entity"), F.col(day).cast("bigint").alias("day_no")).agg(
        F.sum(amount_cents).alias("cents"), F.count(F.lit(1)).alias("n")
    )


def _state_columns(windows: Sequence[int]) -> list[str]:
    return [f"{m}_{w}" for w in windows for m in ("cents", "n")]


def rolling_state(daily: DataFrame, windows: Sequence[int] = WINDOWS, *, horizon: int | None = None) -> DataFrame:
    """Runs of constant state: ``entity, first_day, last_day, day_from, day_to, cents_w.., n_w..``.

    Runs cover every day from an entity's first day to its last active day, or to ``horizon`` if
    given. ``daily`` needs one row per entity and day (``daily_totals``). Empty in, empty out.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be at least one day")
    entries = [F.struct(F.lit(0).alias("w"), F.col("day_no").alias("at"), F.col("cents").alias("c"), F.col("n").alias("k"))]
    entries += [F.struct(F.lit(w).alias("w"), (F.col("day_no") + w).alias("at"), (-F.col("cents")).alias("c"), (-F.col("n")).alias("k")) for w in windows]
    signed = daily.select("entity", F.inline(F.array(*entries)))
    arrived = F.col("w") == 0
    changes = signed.groupBy("entity", "at").agg(
        F.max(arrived.cast("int")).alias("active"),
        *(F.sum(F.when(arrived | (F.col("w") == w), F.col(m[0] if m == "cents" else "k")).otherwise(0)).alias(f"{m}_{w}") for w in windows for m in ("cents", "n")),
    )
    by_day = Window.partitionBy("entity").orderBy("at")
    whole = Window.partitionBy("entity")
    run = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active_day = F.when(F.col("active") == 1, F.col("at"))
    end = F.max(active_day).over(whole) if horizon is None else F.lit(horizon).cast("bigint")
    state = changes.select(
        "entity", F.min("at").over(whole).alias("first_day"), end.alias("last_day"), F.col("at").alias("day_from"),
        F.lead("at").over(by_day).alias("next_at"), *(F.sum(c).over(run).alias(c) for c in _state_columns(windows)),
    )
    return state.filter("day_from <= last_day").select(
        "entity", "first_day", "last_day", "day_from",
        F.least(F.coalesce(F.col("next_at") - 1, F.col("last_day")), F.col("last_day")).alias("day_to"), *_state_columns(windows),
    )


def expand_days(runs: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One row per entity and day, active or not, out of ``rolling_state``'s runs."""
    return runs.select("entity", "first_day", "last_day", F.explode(F.sequence("day_from", "day_to")).alias("day_no"), *_state_columns(windows))


def advance_day(state: DataFrame, daily: DataFrame, day_no: int, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The state after ``day_no`` from the state after the day before.

    ``state`` has ``(entity, cents_w.., n_w..)``; ``daily`` is read only at ``day_no`` and at the
    expiring days, which prunes a table partitioned by day. New entities enter with their first
    amount; entities keep a row of zeros when everything has expired.
    """
    moved = [(0, day_no)] + [(w, day_no - w) for w in windows]
    part = daily.filter(F.col("day_no").isin([d for _, d in moved])).select("entity", "day_no", "cents", "n")
    signed = part.groupBy("entity").agg(
        *(
            F.sum(F.when(F.col("day_no") == day_no, F.col(m)).when(F.col("day_no") == day_no - w, -F.col(m)).otherwise(0)).alias(f"__{m}_{w}")
            for w in windows
            for m in ("cents", "n")
        )
    )
    joined = state.join(signed, "entity", "full_outer")
    return joined.select(
        "entity", *((F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in _state_columns(windows))
    )


def daily_corrections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed ``(entity, day_no, cents, n)`` by which ``new`` daily totals differ from ``old``."""
    signed = old.select("entity", "day_no", (-F.col("cents")).alias("cents"), (-F.col("n")).alias("n")).unionByName(new.select("entity", "day_no", "cents", "n"))
    return signed.groupBy("entity", "day_no").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n")).filter("cents <> 0 OR n <> 0")


def correct_state(
    old_daily: DataFrame, corrections: DataFrame, version: int, windows: Sequence[int] = WINDOWS, *, horizon: int | None = None
) -> DataFrame:
    """Day rows of version ``version`` for the days that ``corrections`` change.

    ``corrections`` are signed ``(entity, day_no, cents, n)`` differences. Only corrected entities
    are read. Returned are the days ``day_no .. day_no + max(windows) - 1`` of every correction (up
    to ``horizon``), and the days from an entity's first to its former first day (to ``horizon`` if
    it is new), which had no row so far; where nothing is in the windows the row has zeros and
    replaces the old one. Days that no correction reaches stay valid.
    """
    reach = max(windows)
    touched = corrections.select("entity").distinct()
    former = old_daily.join(touched, "entity", "left_semi").select("entity", "day_no", "cents", "n")
    merged = (
        former.unionByName(corrections.select("entity", "day_no", "cents", "n"))
        .groupBy("entity", "day_no").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n")).filter("n > 0")
    )
    days = expand_days(rolling_state(merged, windows, horizon=horizon), windows)
    reached = corrections.select("entity", F.explode(F.sequence("day_no", F.col("day_no") + (reach - 1))).alias("day_no"))
    first = merged.groupBy("entity").agg(F.min("day_no").alias("a"), F.max("day_no").alias("z"))
    before = first.join(former.groupBy("entity").agg(F.min("day_no").alias("b")), "entity", "left")
    last = F.coalesce(F.col("b") - 1, F.col("z") if horizon is None else F.lit(horizon).cast("bigint"))
    new_days = before.select("entity", "a", last.alias("y")).filter("a <= y").select("entity", F.explode(F.sequence("a", "y")).alias("day_no"))
    affected = reached.unionByName(new_days).distinct()
    if horizon is not None:
        affected = affected.filter(F.col("day_no") <= horizon)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in _state_columns(windows)}
    return affected.join(days, ["entity", "day_no"], "left").withColumns({**zero, "version": F.lit(version)}).select("entity", "day_no", *_state_columns(windows), "version")


def latest_version(versions: DataFrame) -> DataFrame:
    """Of several versions of an entity's day, the newest."""
    w = Window.partitionBy("entity", "day_no").orderBy(F.col("version").desc())
    return versions.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


@dataclass
class VersionedState:
    """Version 1 (``runs`` of the back-fill, ``advanced`` days) and the days that version 2, ``fixed``, replaces."""

    runs: DataFrame
    advanced: DataFrame
    fixed: DataFrame
    windows: Sequence[int] = WINDOWS

    def _columns(self) -> list[str]:
        return ["entity", "day_no", *_state_columns(self.windows), "version"]

    def where(self, condition: str) -> DataFrame:
        """The valid day rows that meet a condition on the state's columns; runs are expanded after it."""
        runs = expand_days(self.runs.filter(condition), self.windows).withColumn("version", F.lit(1)).select(self._columns())
        former = runs.unionByName(self.advanced.filter(condition))
        return former.join(self.fixed.select("entity", "day_no"), ["entity", "day_no"], "left_anti").unionByName(self.fixed.filter(condition))

    def rows(self) -> DataFrame:
        """The valid row of every entity and day from its first day on; only corrected entities are compared by version."""
        touched = self.fixed.select("entity").distinct()
        parts = []
        for how in ("left_anti", "left_semi"):
            runs = expand_days(self.runs.join(touched, "entity", how), self.windows).withColumn("version", F.lit(1)).select(self._columns())
            parts.append(runs.unionByName(self.advanced.join(touched, "entity", how).select(self._columns())))
        return parts[0].unionByName(latest_version(parts[1].unionByName(self.fixed)))


def maintain_state(old: DataFrame, new: DataFrame, scratch: Scratch, *, horizon: int, days_advanced: int = 7, windows: Sequence[int] = WINDOWS) -> VersionedState:
    """The state up to day ``horizon``: version 1 from the daily totals ``old``, corrected to ``new``.

    All days but the last ``days_advanced`` are back-filled; each of the others joins the state of
    the day before with its arrivals and the expiring days.
    """
    columns = ["entity", "day_no", *_state_columns(windows), "version"]
    start = horizon - days_advanced
    runs = scratch.table(rolling_state(old.filter(F.col("day_no") <= start), windows, horizon=start), "runs")
    state = runs.filter(F.col("day_to") == start).select("entity", *_state_columns(windows))
    advanced = old.sparkSession.createDataFrame([], runs.select("entity", F.col("day_from").alias("day_no"), *_state_columns(windows), F.lit(1).alias("version")).schema)
    for day in range(start + 1, horizon + 1):
        state = scratch.table(advance_day(state, old, day, windows), f"day-{day}")
        advanced = advanced.unionByName(state.select("entity", F.lit(day).cast("bigint").alias("day_no"), *_state_columns(windows), F.lit(1).alias("version")))
    fixed = scratch.table(correct_state(old, daily_corrections(old, new), 2, windows, horizon=horizon), "fixed")
    return VersionedState(runs, advanced.select(columns), fixed, windows)
