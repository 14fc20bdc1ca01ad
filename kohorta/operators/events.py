"""Hospital stays, infection episodes and follow-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions.dates import diff_days_exact, diff_years, rate_per_year
from kohorta.functions.nulls import flag, later_of, void_before, zero_if_null
from kohorta.operators.prefixes import with_prefix_labels
from kohorta.operators.keyed import first_per_key, keep_cohort
from kohorta.operators.ordered import Carry, carry

# Register labels of admission and discharge.
ADT_LABELS = {"INDLÆGGELSE": "IND", "UDSKRIVNING": "UD"}


def adt_events(
    raw: DataFrame,
    labels: Mapping[str, str] = ADT_LABELS,
    key: str = "patientid",
    time: str = "effective_time",
    kind: str = "event_type_name",
) -> DataFrame:
    """Distinct admissions and discharges; ``seq`` sorts an admission before a
    discharge at the same time."""
    named = F.when(F.lit(False), F.lit(None))
    for old, new in labels.items():
        named = named.when(F.col(kind) == old, F.lit(new))
    return (
        raw.select(key, F.col(time).alias("time"), named.alias("event"))
        .where(F.col("event").isNotNull())
        .withColumn("seq", F.when(F.col("event") == "IND", 1).otherwise(2))
        .distinct()
    )


def inside_follow_up(
    events: DataFrame,
    index: DataFrame,
    start: str = "date_diagnosis",
    end: str = "date_death_fu",
    key: str = "patientid",
) -> DataFrame:
    """Events strictly after the index date and strictly before the end of follow-up."""
    return (
        events.join(index.select(key, F.col(start).alias("_t0"), F.col(end).alias("_t1")), key)
        .where((F.col("time") > F.col("_t0")) & (F.col("time") < F.col("_t1")))
        .drop("_t0", "_t1")
    )


def stays(events: DataFrame, key: str = "patientid", chunk: str = "day") -> DataFrame:
    """Stays of each subject: an admission that opens a run, up to the next discharge.

    A repeated admission or discharge belongs to the run before it, and a discharge
    with no admission opens nothing.  Pairing is per subject and crosses chunk borders
    (see ``ordered``), so a very long event sequence is spread over many tasks; use a
    finer chunk (``hour``) where one subject owns a large share of all events.
    """
    marked = carry(
        events,
        [key],
        ["time", "seq"],
        F.date_trunc(chunk, F.col("time")),
        {
            "previous": Carry("lag", F.col("event")),
            "discharge": Carry("up", F.when(F.col("event") == "UD", F.col("time"))),
        },
    )
    opens = (F.col("event") == "IND") & (F.col("previous").isNull() | (F.col("previous") != "IND"))
    return marked.where(opens & F.col("discharge").isNotNull()).select(
        key,
        F.col("time").alias("date_admission"),
        F.col("discharge").alias("date_discharge"),
        diff_days_exact(F.col("time"), F.col("discharge")).alias("days"),
    )


def stay_totals(stay: DataFrame, key: str = "patientid") -> DataFrame:
    """Contacts and days in hospital per subject."""
    return stay.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_contacts"), F.sum("days").alias("days_in_hospital")
    )


def long_stays(stay: DataFrame, more_than_days: float = 1.0, key: str = "patientid") -> DataFrame:
    """Stays longer than the limit, with the subject's totals over all stays.

    One aggregate, no join back: stays of a subject do not overlap, so the long ones it
    collects per subject are no more than the days of follow-up over the limit.
    """
    columns = ["date_admission", "date_discharge", "days"]
    kept = F.when(F.col("days") > more_than_days, F.struct(*[c for c in columns if c in stay.columns]))
    return (
        stay.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n_contacts"),
            F.sum("days").alias("days_in_hospital"),
            F.collect_list(kept).alias("_long"),
        )
        .select(key, "n_contacts", "days_in_hospital", F.inline("_long"))
    )


def admission_follow_up(
    index: DataFrame,
    stay: DataFrame,
    go_live: DataFrame,
    hospitals: Sequence | None = None,
    key: str = "patientid",
    drop_early: bool = False,
    at: str = "date_admission",
) -> DataFrame:
    """One row per long stay (or one censored row) from the later of diagnosis and go-live.  The event is dated by
    ``at``: the admission, or ``date_discharge`` for the row that ends the stay.
    ``stay`` holds long stays only: few per subject, so the outer join cannot be skewed.

    A stay before go-live is dropped and the subject kept as censored; with
    ``drop_early`` a subject whose only stays lie before go-live leaves.
    """
    cohort = index.join(go_live, "hospital_id", "left")
    if hospitals is not None:
        cohort = cohort.where(F.col("hospital_id").isin(list(hospitals)))
    cohort = cohort.where(F.col("date_death_fu") >= F.col("date_golive"))
    live = cohort.select(key, F.col("date_golive").alias("_live"))
    late = stay.join(live, key).where(F.col(at) > F.col("_live")).drop("_live")
    if drop_early:
        cohort = cohort.join(stay.select(key, F.lit(1).alias("_any")).distinct(), key, "left")
    out = cohort.join(late, key, "left")
    if drop_early:
        out = out.where(F.col("date_admission").isNotNull() | F.col("_any").isNull()).drop("_any")
    begin = later_of(F.col("date_diagnosis"), F.col("date_golive"))
    stop = F.coalesce(F.to_date(at), F.col("date_death_fu"))
    return out.withColumns(
        {
            "date_start": begin,
            "date_stop": stop,
            "time_to_end": diff_years(begin, F.col("date_death_fu")),
            "time_to_admission": diff_years(begin, stop),
            "admitted": flag(F.col("date_admission")),
            "days": F.coalesce("days", F.lit(0.0)),
            "days_in_hospital": F.coalesce("days_in_hospital", F.lit(0.0)),
            "n_contacts": F.coalesce("n_contacts", F.lit(0)),
        }
    ).withColumn(
        "contacts_per_year",
        zero_if_null(rate_per_year(F.col("n_contacts"), diff_years(F.col("date_diagnosis"), F.col("date_death_fu")))),
    )


def first_event(df: DataFrame, order: Sequence[str | Column], key: str = "patientid") -> DataFrame:
    """Earliest row per subject."""
    return first_per_key(df, [key], order)


def classify_antimicrobials(
    administrations: DataFrame, prefixes: Sequence[tuple[str, str]], code: str = "atc"
) -> DataFrame:
    """Administrations of listed drugs, with the class of the longest matching prefix."""
    return with_prefix_labels(administrations, code, prefixes, "ab_class", longest=True)


def exclude_drug(administrations: DataFrame, code: str, label: str, route: str | None = None) -> DataFrame:
    """Drop one drug by code and by class label; optionally keep one route only."""
    out = administrations.where((F.col("atc") != code) & (F.col("ab_class") != label))
    return out if route is None else out.where(F.col("route") == route)


def infection_episodes(
    administrations: DataFrame, max_gap_days: int = 2, min_days: int = 1, key: str = "patientid"
) -> DataFrame:
    """Sessions of treatment days: a gap above ``max_gap_days`` starts a new episode.

    Administrations shrink to distinct (subject, day) before any ordering, so what a
    window sees per subject is bounded by the calendar.  One row per episode:
    ``date_infection``, ``date_last``, ``n_days_iv`` (treatment days), ``days_since``
    (from the last treatment day before) and ``n_inf`` (episodes of the subject).
    """
    days = administrations.select(key, F.to_date("date").alias("day")).distinct()
    by_day = Window.partitionBy(key).orderBy("day")
    gap = F.date_diff("day", F.lag("day").over(by_day))
    marked = days.withColumn("gap", gap).withColumn(
        "episode",
        F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > max_gap_days), 1).otherwise(0)).over(
            by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    episodes = (
        marked.groupBy(key, "episode")
        .agg(
            F.min("day").alias("date_infection"),
            F.max("day").alias("date_last"),
            F.count(F.lit(1)).alias("n_days_iv"),
            F.min_by("gap", "day").alias("days_since"),
        )
        .where(F.col("n_days_iv") >= min_days)
    )
    whole = Window.partitionBy(key)
    return episodes.withColumn("n_inf", F.count(F.lit(1)).over(whole)).drop("episode")


def truncate(
    df: DataFrame,
    date_event: str,
    date_start: str,
    cutoff,
    end: str = "date_death_fu",
) -> DataFrame:
    """Administrative censoring: an event on the cut-off day counts, a later one is
    censored at the cut-off.  Adds ``date_end``, ``event`` and ``time_truncated`` (years)."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("date")
    stop = F.least(F.col(date_event), F.col(end), limit)
    seen = F.col(date_event).isNotNull() & (F.col(date_event) <= F.least(F.col(end), limit))
    return df.withColumns(
        {
            "date_end": stop,
            "event": seen.cast("int"),
            "time_truncated": diff_years(F.col(date_start), stop),
        }
    )


def infection_follow_up(
    index: DataFrame,
    episodes: DataFrame,
    go_live: DataFrame,
    cutoff,
    key: str = "patientid",
    sum_voided: bool = False,
) -> DataFrame:
    """First infection after the start, total treatment days, event and truncated time.

    Episodes before the start are voided; their days count only with ``sum_voided``.
    """
    start = later_of(F.col("date_diagnosis"), F.col("date_golive"))
    cohort = index.join(go_live, "hospital_id", "left").withColumn("date_start", start)
    valid = void_before(F.col("date_infection"), F.col("date_start"))
    counted = F.col("n_days_iv") if sum_voided else F.when(valid.isNotNull(), F.col("n_days_iv"))
    per_key = (
        episodes.join(cohort.select(key, "date_start"), key)
        .groupBy(key)
        .agg(
            F.min(valid).alias("date_infection"),
            F.sum(counted).alias("n_days_iv_sum"),
            F.max("n_inf").alias("n_inf"),
        )
    )
    out = keep_cohort(cohort, per_key, key, zeros=["n_days_iv_sum"])
    out = truncate(out, "date_infection", "date_start", cutoff)
    years = diff_years(F.col("date_diagnosis"), F.col("date_death_fu"))
    return out.withColumn("n_inf_per_year", zero_if_null(rate_per_year(F.col("n_inf"), years))).where(
        F.col("time_truncated") >= 0
    )


def infection_totals(cohort: DataFrame, episodes: DataFrame, key: str = "patientid") -> DataFrame:
    """Episodes and treatment days per cohort subject, 0 when none."""
    per_key = episodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_infections"), F.sum("n_days_iv").alias("n_days_on_ab")
    )
    return keep_cohort(cohort, per_key, key, zeros=["n_infections", "n_days_on_ab"])
