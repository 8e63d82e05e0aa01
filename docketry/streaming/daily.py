"""The daily run: its tasks in order, each one transaction on the store of tables, none stopping the others.

A task's tables change together, when it is done; a run that dies in a task leaves the tables as the task before left them.
Each commit notes the task with the versions of the tables it read and wrote: that is the ledger of the run. A run of the
same day that is started again goes on with the first task that failed, is missing or would now read another version;
tasks before it are not done again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.dates import as_moment, midnight
from docketry.operators.casework import (
    HEAL_LEDGER,
    HEAL_STEPS,
    bid_update,
    extract_cases,
    extraction_todo,
    heal_due,
    heal_recorded,
    heal_report,
    mark_attempted,
    merge_second_source,
    missing_bid_repair,
    sticky_apply,
)
from docketry.operators.maintenance import candidates, enqueue, quarantine, upsert_cases
from docketry.operators.timeline import apply_state, entered_state, finalize, sale_on_upcoming, stale_pass, transitions
from docketry.plans.serving import missing_sets
from docketry.sources.versions import Snapshot, TableStore, Transaction
from docketry.streaming.intake import fill_descriptions, new_events

AUDIT = "task_name string, task_order int, items bigint, status string, error_message string"


def _finalized() -> Column:
    return F.coalesce(F.col("is_finalized"), F.lit(False))


def _own(rows: DataFrame, cases: DataFrame) -> DataFrame:
    return rows.join(cases.select("case_id"), "case_id", "left_semi")


def case_id_of(number: str) -> Column:
    """Positive id of a new case from its number."""
    return F.xxhash64(number).bitwiseAND(F.lit(2**62 - 1))


def merged(cases: DataFrame, found: DataFrame, fields: list[str], missing_only: bool = False) -> DataFrame:
    """``cases`` with the non-NULL ``fields`` of ``found`` (one row a case) written in, or only where they lack a value."""
    new = found.select("case_id", *[F.col(c).cast(cases.schema[c].dataType).alias(f"__{c}") for c in fields])
    first = lambda c: (F.coalesce(c, f"__{c}") if missing_only else F.coalesce(f"__{c}", c)).alias(c)
    return cases.join(new, "case_id", "left").select(*[first(c) if c in fields else F.col(c) for c in cases.columns])


def with_stamp(documents: DataFrame, name: str) -> DataFrame:
    """``documents`` with a moment column, NULL where the table has none."""
    return documents if name in documents.columns else documents.withColumn(name, F.lit(None).cast("timestamp_ntz"))


def children_of(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows by case number as rows by case id, for the accepted cases only."""
    return rows.join(accepted.select("case_number", "case_id"), "case_number").drop("case_number")


@dataclass(frozen=True)
class Task:
    """A step of the day: the tables it looks at (those that are not there count as none) and its work, which stages new
    tables and gives the number of rows it dealt with."""

    name: str
    reads: tuple[str, ...]
    work: Callable[[DailyRun, Transaction], int]


class DailyRun:
    """The tasks of a day over the tables of a store.

    Expected: cases, case_events, docket_documents, analyses; ``parsed_events`` and ``incoming`` as the day's intake, with
    ``incoming_events``, ``incoming_parties``, ``incoming_hearings`` and ``quarantine`` if new cases are to be judged, and
    ``second_source`` readings. ``tables`` are put into the store first, as one version; a run started again gives only
    what has changed. Finalized cases are left as they are.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], store: str, as_of: datetime | str):
        self.spark, self.as_of, self.audit = spark, as_of, []
        self.store = TableStore(spark, store)
        if tables:
            with self.store.begin() as t:
                for name, df in tables.items():
                    t.write(name, df)
                t.commit({"kind": "input", "run": str(as_of)})

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The tables as the newest version has them."""
        newest = self.store.snapshot()
        return {name: self.store.read(name, newest) for name in newest.tables}

    # --- tasks ---------------------------------------------------------------------------------------------------------

    def ingest(self, t: Transaction) -> int:
        """Known case numbers are brought up to date; unknown ones become cases with their events, parties and hearings if
        the candidate rule holds, else they are put in quarantine with their events."""
        incoming, cases = t.read("incoming"), t.read("cases")
        if t.has("incoming_events"):
            events = t.read("incoming_events")
            known = incoming.join(cases.select("case_number"), "case_number", "left_semi")
            unknown = incoming.join(cases.select("case_number"), "case_number", "left_anti")
            judged = t.write("incoming_judged", unknown.join(
                candidates(unknown, events, "case_number").select("case_number", "is_candidate"), "case_number"))
            packed = events.groupBy("case_number").agg(F.array_sort(F.collect_list(F.struct(
                F.date_format("event_date", "MM/dd/yyyy").alias("event_date"), "event_type", "document_title",
                F.lit(False).alias("has_document")))).alias("events"))
            refused = judged.where(~F.col("is_candidate")).select("case_number", "case_type").join(packed, "case_number", "left")
            kept = t.read("quarantine") if t.has("quarantine") else self.spark.createDataFrame([], "case_number string, scrape_date date")
            added = t.write("quarantine_added", quarantine(refused, kept, str(self.as_of)[:10]))
            if t.has("quarantine"):
                t.write("quarantine", kept.unionByName(added, allowMissingColumns=True).select(*kept.columns))
            # a stable id from the number, so that a repeated run makes the same case
            accepted = judged.where("is_candidate").drop("is_candidate").withColumn("case_id", case_id_of("case_number"))
            incoming = known.unionByName(accepted, allowMissingColumns=True)
            own = children_of(events, accepted).select(
                F.xxhash64("case_id", "event_date", "event_type", "event_description").alias("event_id"), "case_id",
                "event_date", "event_type", "event_description")
            t.write("case_events", t.read("case_events").unionByName(own.distinct(), allowMissingColumns=True))
            for name in ("parties", "hearings"):
                if t.has(f"incoming_{name}"):
                    new = children_of(t.read(f"incoming_{name}"), accepted).distinct()
                    t.write(name, t.read(name).unionByName(new, allowMissingColumns=True) if t.has(name) else new)
        return t.write("cases", upsert_cases(cases, incoming, self.as_of)).count()

    def extract(self, t: Transaction) -> int:
        """Open cases with a text no extraction has seen, or with no document yet, are read; the texts are marked."""
        cases, documents = t.read("cases"), with_stamp(t.read("docket_documents"), "extraction_attempted_at")
        bare = cases.join(documents.select("case_id").where("case_id IS NOT NULL"), "case_id", "left_anti")
        due = extraction_todo(documents).unionByName(bare.select("case_id"))
        todo = t.write("extract_todo", cases.where(~_finalized()).join(due, "case_id", "left_semi"))
        read = extract_cases(todo, _own(t.read("case_events"), todo), _own(documents, todo))
        others = cases.join(todo.select("case_id"), "case_id", "left_anti")
        done = t.write("cases", sticky_apply(todo, read).unionByName(others, allowMissingColumns=True))
        t.write("docket_documents", mark_attempted(documents, todo, as_moment(self.as_of).cast("timestamp_ntz")))
        return done.count()

    def monitor(self, t: Transaction) -> int:
        """New events of the cases still open, then their states, history, triggers, bids and finalization."""
        cases = t.read("cases")
        open_cases, done = cases.where(~_finalized()), cases.where(_finalized())
        stored, parsed = t.read("case_events"), _own(t.read("parsed_events"), open_cases)
        added = t.write("events_added", new_events(stored, parsed))
        events = t.write("case_events", fill_descriptions(stored, parsed).unionByName(added, allowMissingColumns=True))
        sold = merged(open_cases, sale_on_upcoming(open_cases, added), ["sale_date", "next_bid_deadline"])
        monitored = t.write("cases_monitored", apply_state(sold, _own(events, open_cases), self.as_of, keep_when_null=True))
        moment = as_moment(self.as_of).cast("timestamp_ntz")
        t.write("transitions", transitions(monitored).withColumn("changed_at", moment))
        t.write("entered_upset_bid", entered_state(monitored).select("case_id", "case_number"))
        current = monitored.drop("old_classification")
        upset = current.where(F.col("classification") == R.UPSET_BID)
        bids = bid_update(upset, _own(events, upset), _own(t.read("docket_documents"), upset)).withColumn(
            "next_bid_deadline", midnight(F.col("deadline")))
        current = merged(current, bids, ["current_bid_amount", "minimum_next_bid", "next_bid_deadline", "sale_date"])
        final = finalize(current, _own(events, open_cases), self.as_of)
        t.write("cases", final.unionByName(done, allowMissingColumns=True))
        return added.count()

    def second_source(self, t: Transaction) -> int:
        """Readings of the second source that no run has merged yet go into the open cases; their documents are stamped."""
        cases, documents = t.read("cases"), with_stamp(t.read("docket_documents"), "vision_processed_at")
        if not t.has("second_source"):
            return 0
        fresh = documents.where(F.col("vision_processed_at").isNull()).select("document_id")
        readings = t.read("second_source").join(fresh, "document_id", "left_semi")
        found = t.write("second_merged", merge_second_source(cases.where(~_finalized()), readings))
        t.write("cases", merged(cases, found, ["property_address", "current_bid_amount", "minimum_next_bid", "legal_description", "sale_date"]))
        seen = readings.join(found.select("case_id"), "case_id", "left_semi").select("document_id", F.lit(True).alias("__hit")).distinct()
        moment = as_moment(self.as_of).cast("timestamp_ntz")
        stamped = documents.join(seen, "document_id", "left").withColumn(
            "vision_processed_at", F.when(F.col("__hit"), moment).otherwise(F.col("vision_processed_at"))).drop("__hit")
        t.write("docket_documents", stamped)
        return found.count()

    def validate(self, t: Transaction) -> int:
        return t.write("incomplete", missing_sets(t.read("cases"))).count()

    def stale(self, t: Transaction) -> int:
        """Past deadlines are extended or the case is classified again; both are written into the cases."""
        cases = t.read("cases")
        open_cases = cases.where(~_finalized())
        late = t.write("stale", stale_pass(open_cases, _own(t.read("case_events"), open_cases), self.as_of))
        found = late.withColumn("classification", F.col("new_state"))
        stamp = cases.join(found.select("case_id", F.col("new_state").alias("__n")), "case_id", "left")
        stamp = stamp.withColumn("closed_sold_at", F.when(
            (F.col("__n") == R.CLOSED_SOLD) & ~F.col("classification").eqNullSafe(F.lit(R.CLOSED_SOLD)), as_moment(self.as_of)
        ).otherwise(F.col("closed_sold_at"))).drop("__n")
        moved = found.where("new_state IS NOT NULL").join(cases.select("case_id", F.col("classification").alias("old_classification")), "case_id")
        moment = as_moment(self.as_of).cast("timestamp_ntz")
        t.write("transitions_stale", transitions(moved.drop("new_state"), "stale").withColumn("changed_at", moment))
        t.write("cases", merged(stamp, found, ["classification", "next_bid_deadline"]))
        return late.count()

    def heal(self, t: Transaction) -> int:
        """Incomplete upset_bid cases go up the healing ladder, a step a day and each step once: read again (what was missing
        is written into the cases), then the list of texts to be read a second time, then that of pages to be fetched."""
        cases, events, documents = t.read("cases"), t.read("case_events"), t.read("docket_documents")
        ledger = t.read("heal_attempts") if t.has("heal_attempts") else self.spark.createDataFrame([], HEAL_LEDGER)
        due = t.write("heal_due", heal_due(cases, documents, ledger))
        ailing = t.write("heal_ailing", cases.join(due.where(F.col("step") == HEAL_STEPS[0]).select("case_id"), "case_id", "left_semi"))
        read = t.write("heal_read", extract_cases(ailing, _own(events, ailing), _own(documents, ailing)))
        healed = t.write("healed", heal_report(ailing, events, documents, read))
        whole = sticky_apply(ailing, read).unionByName(cases.join(ailing.select("case_id"), "case_id", "left_anti"), allowMissingColumns=True)
        t.write("cases", merged(whole, missing_bid_repair(ailing, documents), ["current_bid_amount", "minimum_next_bid"], missing_only=True))
        t.write("heal_attempts", heal_recorded(ledger, due, as_moment(self.as_of).cast("timestamp_ntz")))
        return healed.count()

    def queue(self, t: Transaction) -> int:
        upset = t.read("cases").where(F.col("classification") == R.UPSET_BID)
        return t.write("analyses", enqueue(t.read("analyses"), upset, self.as_of)).count()

    # --- the run -------------------------------------------------------------------------------------------------------

    def _history(self) -> list[Snapshot]:
        return [self.store.snapshot(n) for n in self.store.numbers()]

    def ledger(self) -> DataFrame:
        """What the tasks of all runs in the store did, in order: run, task, items, status, error, versions read and written."""
        rows = [(v.number, n["run"], n["task"], n["order"], n["items"], n["status"], n["error"], n["inputs"], n["outputs"])
                for v in self._history() if (n := v.note).get("kind") == "task"]
        return self.spark.createDataFrame(rows, "version bigint, run string, task_name string, task_order int, items bigint, status string, "
                                                "error_message string, inputs map<string,string>, outputs map<string,string>")

    def run(self) -> DataFrame:
        """Do what is to be done of the day; one audit row per task: success, failed, or unchanged if it need not be done."""
        history = self._history()
        notes = [v.note for v in history if v.note.get("kind") == "task" and v.note["run"] == str(self.as_of)]
        entries = {t["folder"]: t for v in history for t in v.tables.values()}
        made = {folder for n in notes for folder in n["outputs"].values()}
        newest = history[-1].tables if history else {}
        # where the day began: tables the run itself has written since are taken as its first reader found them
        state = {}
        for name, entry in newest.items():
            before = [f for n in notes if (f := n["inputs"].get(name)) and f not in made]
            folder = entry["folder"] if entry["folder"] not in made else before[0] if before else None
            if folder in entries:
                state[name] = entries[folder]
        for order, task in enumerate(TASKS):
            inputs = {name: state[name]["folder"] for name in task.reads if name in state}
            done = [n for n in notes if n["task"] == task.name and n["status"] == "success" and n["inputs"] == inputs
                    and all(f in entries for f in n["outputs"].values())]
            if done:
                state |= {name: entries[f] for name, f in done[-1]["outputs"].items()}
                self.audit.append((task.name, order, done[-1]["items"], "unchanged", None))
                continue
            note = {"kind": "task", "run": str(self.as_of), "task": task.name, "order": order, "inputs": inputs}
            with self.store.begin(Snapshot(0, state)) as t:
                try:
                    note |= {"items": task.work(self, t), "status": "success", "error": None}
                except Exception as error:  # noqa: BLE001 - a failing task must not stop the run
                    t.abort()
                    note |= {"items": 0, "status": "failed", "error": str(error)}
                written = dict(t.staged)
                t.commit(note | {"outputs": {name: entry["folder"] for name, entry in written.items()}})
            state |= written
            entries |= {entry["folder"]: entry for entry in written.values()}
            self.audit.append((task.name, order, note["items"], note["status"], note["error"]))
        return self.spark.createDataFrame(self.audit, AUDIT)


TASKS = (
    Task("ingest", ("cases", "case_events", "parties", "hearings", "quarantine", "incoming", "incoming_events", "incoming_parties",
                    "incoming_hearings"), DailyRun.ingest),
    Task("extract", ("cases", "case_events", "docket_documents"), DailyRun.extract),
    Task("monitor", ("cases", "case_events", "docket_documents", "parsed_events"), DailyRun.monitor),
    Task("second_source", ("cases", "docket_documents", "second_source"), DailyRun.second_source),
    Task("validate", ("cases",), DailyRun.validate),
    Task("stale", ("cases", "case_events"), DailyRun.stale),
    Task("heal", ("cases", "case_events", "docket_documents", "heal_attempts"), DailyRun.heal),
    Task("queue", ("cases", "analyses"), DailyRun.queue),
)
