"""Case state from the event timeline.

One hash aggregate over the events carries every rule. A group's latest event with undated events first reduces to a
plain maximum once an undated event counts as the end of time, so no window and no per-rule pass is needed, and a
case with very many events is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.dates import as_day, as_moment, at_five_pm, midnight
from docketry.functions.predicates import event_flags, is_foreclosure_type
from docketry.operators.calendar import with_deadline


def _undated() -> Column:
    return F.lit("9999-12-31").cast("date")


def _newest(flag: Column) -> Column:
    """Newest date among flagged events, an undated one counting as newest of all."""
    return F.max(F.when(flag, F.coalesce(F.col("event_date"), _undated())))


def case_timeline(events: DataFrame) -> DataFrame:
    """One row per case with the newest date per rule; NULL means no such event, the marker means undated."""
    flag = event_flags(F.col("event_type"), lowered=True)
    dated = F.col("event_date")
    narrow = events.select("case_id", "event_date", F.lower("event_type").alias("event_type"))
    return narrow.groupBy("case_id").agg(
        _newest(flag["is_withdrawn"]).alias("withdrawn"),
        _newest(flag["is_dismissal"]).alias("dismissed"),
        _newest(flag["is_reversed"]).alias("reversed"),
        _newest(flag["is_sale"]).alias("sale"),
        F.count_if(flag["is_sale_baseline"]).alias("baseline_count"),
        F.min(F.when(flag["is_sale_baseline"], dated)).alias("baseline_first"),
        F.max(F.when(flag["is_set_aside"], dated)).alias("set_aside"),
        _newest(flag["is_upset"]).alias("upset"),
        F.max(F.when(flag["is_upset_filed"], dated)).alias("upset_filed"),
        _newest(flag["is_bankruptcy"]).alias("bankruptcy"),
        _newest(flag["is_lifted"]).alias("lifted"),
        F.bool_or(flag["is_confirmed"]).alias("has_confirmed"),
        F.bool_or(flag["is_initiated"]).alias("has_initiated"),
        F.bool_or(flag["is_legacy"]).alias("has_legacy"),
    )


def _day(name: str) -> Column:
    """Date behind a newest-date column, NULL when undated."""
    return F.nullif(F.col(name), _undated())


def _undone_later(cause: str, cure: str) -> Column:
    """A later cure, or a cure that cannot be compared by date."""
    comparable = _day(cause).isNotNull() & _day(cure).isNotNull()
    return F.col(cure).isNotNull() & (~comparable | (_day(cure) > _day(cause)))


def classify(cases: DataFrame, events: DataFrame, as_of: datetime) -> DataFrame:
    """State per case plus the sale fields as the rules leave them.

    ``cases`` needs case_id, case_type, sale_date, current_bid_amount, minimum_next_bid, next_bid_deadline,
    closed_sold_at. Output: those keys with ``new_state``, ``new_sale_date``, ``is_resale``, ``is_set_aside`` and the
    cleared fields (``kept_*``).
    """
    now, today = as_moment(as_of), as_day(as_of)
    t = cases.join(case_timeline(events), "case_id", "left")

    withdrawn = _day("withdrawn").isNotNull() & (_day("sale").isNull() | (_day("withdrawn") >= _day("sale")))
    t = t.withColumn("__withdrawn", F.coalesce(withdrawn, F.lit(False)))
    t = t.withColumn("__dismissed", ~F.col("__withdrawn") & F.col("dismissed").isNotNull()
                     & ~_undone_later("dismissed", "reversed"))
    t = t.withColumn("__open_sale", ~F.col("__withdrawn") & ~F.col("__dismissed") & F.col("sale").isNotNull())

    # Resale and set-aside act on the stored fields before the deadline tests see them.
    baseline = F.coalesce(F.col("sale_date"), F.when(F.col("baseline_count") > 1, F.col("baseline_first")))
    sold = _day("sale")
    t = t.withColumn("is_resale", F.coalesce(F.col("__open_sale") & (sold > baseline), F.lit(False)))
    t = t.withColumn("is_set_aside", F.coalesce(F.col("__open_sale") & (F.col("set_aside") > sold), F.lit(False)))
    fresh_sale = F.when(F.col("is_set_aside"), None).when(F.col("is_resale"), sold).when(
        F.col("__open_sale"), F.coalesce(F.col("sale_date"), sold)).otherwise(F.col("sale_date"))
    t = t.withColumn("new_sale_date", fresh_sale)
    cleared = F.col("is_resale") | F.col("is_set_aside")
    for name in ("current_bid_amount", "minimum_next_bid", "next_bid_deadline", "closed_sold_at"):
        t = t.withColumn(f"kept_{name}", F.when(~cleared, F.col(name)))

    cycle = F.when(F.col("new_sale_date").isNull() | (F.col("upset_filed") >= F.col("new_sale_date")),
                   F.col("upset_filed"))
    t = t.withColumn("cycle_upset", cycle)
    reference = F.when(~F.col("is_set_aside"), F.greatest(sold, F.when(_day("upset") > sold, _day("upset"))))
    t = t.withColumn("__reference", reference)
    t = with_deadline(t, F.col("cycle_upset"), "cycle_deadline")
    t = with_deadline(t, F.col("__reference"), "__reference_deadline")

    running = (
        (today <= F.col("cycle_deadline"))
        | (now <= F.col("kept_next_bid_deadline").cast("timestamp_ntz"))
        | (now <= at_five_pm(F.col("__reference_deadline")))
    )
    blocked_inside = (_day("bankruptcy") > F.col("__reference")) & (
        _day("bankruptcy") <= F.col("__reference_deadline"))
    sale_state = (
        F.when(F.coalesce(today <= F.col("cycle_deadline"), F.lit(False)), R.UPSET_BID)
        .when(F.coalesce(running, F.lit(False)), R.UPSET_BID)
        .when(F.coalesce(blocked_inside, F.lit(False)),
              F.when(_day("lifted") > _day("bankruptcy"), R.UPCOMING).otherwise(R.BLOCKED))
        .when(~F.col("is_set_aside"), R.CLOSED_SOLD)
    )
    no_sale_state = (
        F.when(F.col("bankruptcy").isNotNull() & ~_undone_later("bankruptcy", "lifted"), R.BLOCKED)
        .when(F.col("has_initiated"), R.UPCOMING)
        .when(F.col("has_legacy") & is_foreclosure_type(F.col("case_type")), R.UPCOMING)
    )
    state = (
        F.when(F.col("__withdrawn"), R.UPCOMING)
        .when(F.col("__dismissed"), R.CLOSED_DISMISSED)
        .when(F.col("__open_sale") & sale_state.isNotNull(), sale_state)
        .otherwise(no_sale_state)
    )
    return t.withColumn("new_state", state).select(
        *[c for c in t.columns if not c.startswith("__")], "new_state")


TIMELINE_COLUMNS = [
    "withdrawn", "dismissed", "reversed", "sale", "baseline_count", "baseline_first", "set_aside", "upset",
    "upset_filed", "bankruptcy", "lifted", "has_confirmed", "has_initiated", "has_legacy",
]


def apply_state(cases: DataFrame, events: DataFrame, as_of: datetime, keep_when_null: bool = False) -> DataFrame:
    """Cases with the new state written in: stamps, cleared sale fields, repaired deadline.

    ``keep_when_null`` keeps the old state where the rules give none (the monitor's way).
    """
    t = classify(cases, events, as_of)
    state = F.coalesce(F.col("new_state"), F.col("classification")) if keep_when_null else F.col("new_state")
    t = t.withColumn("__state", state)
    sold_at = (
        F.when((F.col("__state") == R.CLOSED_SOLD) & ~F.col("classification").eqNullSafe(F.lit(R.CLOSED_SOLD)),
               as_moment(as_of))
        .when(~F.col("__state").eqNullSafe(F.lit(R.CLOSED_SOLD))
              & F.col("classification").eqNullSafe(F.lit(R.CLOSED_SOLD)), None)
        .otherwise(F.col("kept_closed_sold_at"))
    )
    # The repair needs the upset bid of the current cycle, else the sale date.
    source = F.coalesce(F.when(F.col("upset_filed") >= F.col("new_sale_date"), F.col("upset_filed")),
                        F.col("new_sale_date"))
    t = with_deadline(t, source, "__repaired")
    stale = F.col("kept_next_bid_deadline").isNull() | (
        F.col("kept_next_bid_deadline").cast("date") < F.col("new_sale_date"))
    deadline = F.when((F.col("__state") == R.UPSET_BID) & F.col("new_sale_date").isNotNull() & stale,
                      midnight(F.col("__repaired"))).otherwise(F.col("kept_next_bid_deadline"))
    written = {
        "old_classification": F.col("classification"),
        "classification": F.col("__state"),
        "closed_sold_at": sold_at,
        "next_bid_deadline": deadline,
        "sale_date": F.col("new_sale_date"),
        "current_bid_amount": F.col("kept_current_bid_amount"),
        "minimum_next_bid": F.col("kept_minimum_next_bid"),
    }
    return t.select(*[F.col(c) for c in cases.columns if c not in written],
                    *[c.alias(n) for n, c in written.items()])


def transitions(applied: DataFrame, trigger: str = "scrape") -> DataFrame:
    """History rows for the cases whose state changed."""
    return (
        applied.where(~F.col("old_classification").eqNullSafe(F.col("classification")))
        .select("case_id", "old_classification", F.col("classification").alias("new_classification"),
                F.lit(trigger).alias("trigger"))
    )


def entered_state(applied: DataFrame, state: str = R.UPSET_BID) -> DataFrame:
    """Cases that have just entered a state; they feed the enrichment and analysis work tables."""
    return applied.where((F.col("classification") == state)
                         & ~F.col("old_classification").eqNullSafe(F.lit(state)))


def cycle_upset(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Newest dated upset bid on or after the stored sale date (any, while there is none)."""
    newest = (
        events.where(event_flags(F.col("event_type"))["is_upset_filed"] & F.col("event_date").isNotNull())
        .groupBy("case_id").agg(F.max("event_date").alias("cycle_upset"))
    )
    return cases.join(newest, "case_id", "left").withColumn(
        "cycle_upset",
        F.when(F.col("sale_date").isNull() | (F.col("cycle_upset") >= F.col("sale_date")), F.col("cycle_upset")))


def stale_pass(cases: DataFrame, events: DataFrame, as_of: datetime) -> DataFrame:
    """upset_bid cases past their deadline: extended by a recent upset bid, else classified again."""
    now, today = as_moment(as_of), as_day(as_of)
    stale = cases.where((F.col("classification") == R.UPSET_BID)
                        & (F.col("next_bid_deadline").cast("timestamp_ntz") < now))
    own_events = events.join(stale.select("case_id"), "case_id", "left_semi")
    recent = with_deadline(cycle_upset(stale, own_events), F.col("cycle_upset"), "__extended")
    recent = recent.select("case_id", F.when(today <= F.col("__extended"), F.col("__extended")).alias("extended_to"))
    state = classify(stale, own_events, as_of).select("case_id", "new_state")
    return (
        stale.select("case_id", "classification", "next_bid_deadline")
        .join(recent, "case_id").join(state, "case_id")
        .select(
            "case_id",
            F.when(F.col("extended_to").isNotNull(), F.lit(R.UPSET_BID)).otherwise(F.col("new_state"))
            .alias("new_state"),
            F.coalesce(midnight(F.col("extended_to")), F.col("next_bid_deadline").cast("timestamp_ntz"))
            .alias("next_bid_deadline"),
            F.col("extended_to").isNotNull().alias("was_extended"),
            (now > at_five_pm(F.col("next_bid_deadline").cast("date"))).alias("is_past_close"),
        )
    )


def finalize(cases: DataFrame, events: DataFrame, as_of: datetime) -> DataFrame:
    """Mark open cases that have a finalization event; the newest one is kept as the reason."""
    final = events.where(event_flags(F.col("event_type"))["is_final"])
    newest = final.groupBy("case_id").agg(
        F.max(F.struct(F.coalesce(F.col("event_date"), _undated()).alias("day"), F.col("event_id"))).alias("f"))
    hit = F.col("f").isNotNull() & ~F.coalesce(F.col("is_finalized"), F.lit(False))
    return cases.join(newest, "case_id", "left").select(
        *[c for c in cases.columns if c not in ("is_finalized", "finalized_at", "finalized_event_id")],
        (F.coalesce(F.col("is_finalized"), F.lit(False)) | hit).alias("is_finalized"),
        F.when(hit, as_moment(as_of)).alias("finalized_at"),
        F.when(hit, F.col("f.event_id")).alias("finalized_event_id"),
    )


def latest_event(events: DataFrame, flag: Column) -> DataFrame:
    """Newest event of one rule per case, undated ones first, larger id on ties."""
    ordered = F.struct(F.coalesce(F.col("event_date"), _undated()).alias("day"), F.col("event_id"),
                       F.col("event_type"))
    newest = events.where(flag).groupBy("case_id").agg(F.max(ordered).alias("e"))
    return newest.select("case_id", F.nullif(F.col("e.day"), _undated()).alias("event_date"),
                         F.col("e.event_id").alias("event_id"), F.col("e.event_type").alias("event_type"))


def sale_on_upcoming(cases: DataFrame, new_events: DataFrame) -> DataFrame:
    """A new sale event on an upcoming case sets its sale date and deadline."""
    sale = (
        new_events.where(event_flags(F.col("event_type"))["is_sale"] & F.col("event_date").isNotNull())
        .groupBy("case_id").agg(F.max("event_date").alias("__sold"))
    )
    t = cases.where(F.col("classification") == R.UPCOMING).join(sale, "case_id")
    return with_deadline(t, F.col("__sold"), "__deadline").select(
        "case_id", F.col("__sold").alias("sale_date"), midnight(F.col("__deadline")).alias("next_bid_deadline"))


def repair_missing_deadlines(cases: DataFrame, events: DataFrame) -> DataFrame:
    """upset_bid cases without a deadline take it from their newest event naming a sale."""
    newest = (
        events.where(F.col("event_date").isNotNull() & F.lower("event_type").contains("sale"))
        .groupBy("case_id").agg(F.max("event_date").alias("__sold"))
    )
    t = cases.where((F.col("classification") == R.UPSET_BID) & F.col("next_bid_deadline").isNull()).join(
        newest, "case_id")
    return with_deadline(t, F.col("__sold"), "__deadline").select(
        "case_id", F.col("__sold").alias("sale_date"), midnight(F.col("__deadline")).alias("next_bid_deadline"))


def baseline_sale(events: DataFrame) -> DataFrame:
    """Oldest dated sale of the cases that have more than one."""
    flag = event_flags(F.col("event_type"))["is_sale_baseline"]
    return (
        events.where(flag).groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("sale_events"), F.min("event_date").alias("baseline_date"))
        .where(F.col("sale_events") > 1)
    )
