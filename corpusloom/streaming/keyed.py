"""What a stream knows of papers and titles, as keyed state: a batch costs what arrives in it, however much came before.

Two stateful steps follow one another. The first holds a paper's standing and title by paper, and turns arrivals and decisions
read back from the log into rows for the second, which holds the number of papers that register a title by title. Their state lies
in the checkpoint, so a restart goes on from it, and a batch that is retried starts from the state before it.

Of a paper's or a title's rows in a batch only the least or latest ones are held while the rest pass, so a paper or title with very
many rows takes no more memory, but one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from corpusloom.functions.text import normalize_title
from corpusloom.operators.store import FAIL_BELOW

#: Standings. Papers that are taken up or done register their title; those that need review, or are taken up again, don't.
TAKEN, DONE, REVIEW, AGAIN = "taken", "done", "review", "again"
REGISTERS = (TAKEN, DONE)

ARRIVAL = "paper_id string, kind string, at long, status string, title string, code string, payload string"
STEP = "title string, kind string, change long, paper_id string, at long, code string, payload string"
OUT = "paper_id string, at long, code string, payload string"
_STEP, _OUT = (Row(*[c.split()[0] for c in s.split(", ")]) for s in (STEP, OUT))


def title_digest(title: Column) -> Column:
    """Of the normalized title; null titles are a group of their own."""
    key = normalize_title(title)
    return F.sha2(F.concat(F.when(key.isNull(), "0").otherwise("1"), F.coalesce(key, F.lit(""))), 256)


def standings(events: DataFrame) -> DataFrame:
    """The log's events that change a paper's standing, as rows of ARRIVAL: decisions, deletions and scores that fail it."""
    fails = (F.col("kind") == "quality") & (F.col("score") < FAIL_BELOW)
    kept = events.where(F.col("paper_id").isNotNull() & (F.col("kind").isin("decide", "delete") | fails))
    null = F.lit(None).cast("string")
    return kept.select("paper_id", "kind", F.col("seq").alias("at"), "status", null.alias("title"), null.alias("code"), null.alias("payload"))


class Papers(StatefulProcessor):
    """Of each paper: standing, the title that it registers, and the seq of the last event that counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("paper", "standing string, title string, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.held.get() if self.held.exists() else None
        was, title, seq = held or (None, None, -1)
        latest, failed, first = (seq, None, None), -1, None
        for r in rows:
            if r.kind == "paper":
                if first is None or (r.at, r.title) < first[:2]:
                    first = (r.at, r.title, r.code, r.payload)
            elif r.kind == "quality":
                failed = max(failed, r.at)
            elif r.at > latest[0]:
                latest = (r.at, r.kind, r.status)
        now = was
        if latest[1] == "delete":
            now = None
        elif latest[1] == "decide":
            now = REVIEW if latest[2] == "NEEDS_REVIEW" else DONE
        if failed > latest[0] and now in (REVIEW, AGAIN):
            now = DONE
        if title is not None and (now in REGISTERS) != (was in REGISTERS):
            yield _STEP(title, "change", 1 if now in REGISTERS else -1, key[0], None, None, None)
        if now is None:
            title = None
        if first is not None:
            at, arrived, code, payload = first
            if now is None:
                now, title = TAKEN, arrived
                yield _STEP(arrived, "new", 1, key[0], at, code, payload)
            elif now == REVIEW:
                now, title = AGAIN, arrived
                yield _STEP(arrived, "again", 0, key[0], at, code, payload)
            elif title is None:  # decided before it arrived
                title = arrived
                yield _STEP(arrived, "decided", 1 if now in REGISTERS else 0, key[0], at, None, None)
        self.held.update((now, title, max(latest[0], failed)))

    def close(self) -> None:
        pass


class Titles(StatefulProcessor):
    """Of each title: how many papers register it now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("title", "registered long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.held.get()[0] if self.held.exists() else 0
        before, registered, first = held, held, None  # before: less what arrives now
        for r in rows:
            registered += r.change
            if r.kind == "change":
                before += r.change
            elif r.kind == "again":
                yield _OUT(r.paper_id, r.at, r.code, r.payload)
            elif r.change:
                later = r
                if first is None or (r.at, r.paper_id) < (first.at, first.paper_id):
                    first, later = r, first
                if later is not None and later.kind == "new":  # another of this batch registers earlier
                    yield _OUT(later.paper_id, later.at, "EC6", None)
        if first is not None and first.kind == "new":
            yield _OUT(first.paper_id, first.at, "EC6", None) if before > 0 else _OUT(first.paper_id, first.at, first.code, first.payload)
        if registered != held:
            self.held.update((registered,))

    def close(self) -> None:
        pass


def taken_up(arrivals: DataFrame) -> DataFrame:
    """Papers that a stream takes up, as rows of OUT, of a stream of ARRIVAL rows: those of ``standings`` and papers of kind ``paper``.

    New papers and those that need review are taken up; those that are decided for good, or taken up and not decided yet, are not.
    Of rows of one paper in a batch the least ``at`` counts. A new paper is EC6 if a paper of its title registers: one of an earlier
    batch, or one of this batch with a lesser ``at`` (the lesser id among equals). A paper that was decided before it arrived
    registers on arrival. A deleted paper is as one that never arrived. Decisions that arrive with a paper count first; of a paper's decisions
    the one of the highest ``seq`` holds. Placeholders of seeds aren't read: the paper counts as undecided until the stream decides it.
    """
    by_paper = arrivals.groupBy("paper_id").transformWithState(Papers(), STEP, "append", "none")
    return by_paper.groupBy("title").transformWithState(Titles(), OUT, "append", "none")
