"""Rules of a key's events, kept as state of a stream with event-time timers.

Files and messages come out of order.  ``InOrder`` holds a key's events until the watermark has passed them and then gives them to a
rule by time and id, so a stream's results are those of the batch forms in ``rules`` whatever the order of arrival within the
watermark's delay, restarts included: what waits and what the rule knows are in the state store.  A rule may ask to be woken at a time; it is
woken between the events before and after it, by a timer if nothing else comes.  A key has one timer at a time, for the first
thing that waits.

Sessions that run these need ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule:
    """What is done with a key's events in order.

    state: its fields, as DDL; ``start`` their first values.  ``event`` and ``timer`` take the state and give the next one, the rows that come
    out (after the key), and when to be woken (milliseconds; None: not).
    """

    state: str
    start: tuple
    out: str

    def event(self, state: tuple, micros: int, what: tuple) -> tuple[tuple, list[tuple], int | None]:
        raise NotImplementedError

    def timer(self, state: tuple, millis: int) -> tuple[tuple, list[tuple], int | None]:
        return state, [], None

    def begun(self, row: Row) -> tuple[tuple, int | None]:
        """State and waking time from a row of the initial state."""
        return tuple(row), None


class Admission(Rule):
    """ST8: an event is shown while its batch is open, or if it always is; a batch without events for ``idle`` milliseconds is closed. what: opens, closes, always, id."""

    state, start, out = "open boolean", (False,), "id long"

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def event(self, state, micros, what):
        opens, closes, always, id_ = what
        shown = state[0] or opens or always
        now = True if opens else False if closes else state[0]
        return (now,), [(id_,)] if shown else [], micros // 1000 + self.idle if now and self.idle is not None else None

    def timer(self, state, millis):
        return (False,), [], None


class Settling(Rule):
    """ST4: a file passes once its size, above zero, has not changed for ``quiet`` milliseconds. what: size."""

    state, start, out = "size long, wake long", (None, None), "size long, passed_ms long"

    def __init__(self, quiet: int):
        self.quiet = quiet

    def event(self, state, micros, what):
        size, wake = state
        if what[0] != size:
            size = what[0]
            wake = micros // 1000 + self.quiet if size is not None and size > 0 else None
        return (size, wake), [], wake

    def timer(self, state, millis):
        return (state[0], None), [(state[0], millis)], None


class Stable(Rule):
    """ST4: the first attempt at which a size above zero has stood for ``repeats`` repeats. what: attempt, size."""

    state, start, out = "size long, n int, done boolean", (None, 0, False), "stable_at long"

    def __init__(self, repeats: int = 2):
        self.repeats = repeats

    def event(self, state, micros, what):
        (size, n, done), (attempt, seen) = state, what
        n = n + 1 if n and seen == size else 1
        passes = not done and seen is not None and seen > 0 and n > self.repeats
        return (seen, n, done or passes), [(attempt,)] if passes else [], None


class InFlight(Rule):
    """ST3: a path that arrives while it is worked on is passed over; it is free again when done, or after ``most`` milliseconds. what: arrives, id."""

    state, start, out = "until long", (None,), "id long"

    def __init__(self, most: int):
        self.most = most

    def event(self, state, micros, what):
        arrives, id_ = what
        if not arrives:
            return (None,), [], None
        if state[0] is not None:
            return state, [], state[0]
        until = micros // 1000 + self.most
        return (until,), [(id_,)], until

    def timer(self, state, millis):
        return (None,), [], None


class Jobs(Rule):
    """ST9: guarded steps of a job. what: step (queue, start, complete, fail, cancel).

    A step that the status does not allow changes nothing.  A job that runs for ``most`` milliseconds without an end is queued again, one attempt later.
    """

    state, start, out = "status string, attempt int", (None, 0), "status string, attempt int, at_ms long"
    ALLOWED = {
        "queue": ((None, "FAILED"), "QUEUED"), "start": (("QUEUED",), "RUNNING"), "complete": (("RUNNING",), "COMPLETE"),
        "fail": (("RUNNING",), "FAILED"), "cancel": (("QUEUED", "RUNNING"), "CANCELLED"),
    }

    def __init__(self, most: int):
        self.most = most

    def event(self, state, micros, what):
        status, attempt = state
        before, after = self.ALLOWED.get(what[0], ((), None))
        if status not in before:
            # a refused step leaves the waking time, which the caller keeps
            return state, [], -1
        attempt += after == "QUEUED" or after == "RUNNING" and attempt == 0
        return (after, attempt), [(after, attempt, micros // 1000)], micros // 1000 + self.most if after == "RUNNING" else None

    def timer(self, state, millis):
        return ("QUEUED", state[1] + 1), [("QUEUED", state[1] + 1, millis)], None

    def begun(self, row):
        return (row["status"], row["attempt"]), row["wake"] if row["status"] == "RUNNING" else None


class InOrder(StatefulProcessor):
    """Gives events (_us, _nth and the columns ``what``) to a rule by time and id once the watermark has passed them."""

    def __init__(self, rule: Rule, key: str, what: list[str], waits: str):
        self.rule, self.key, self.what, self.waits = rule, key, what, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.known = handle.getValueState("known", self.rule.state)
        self.times = handle.getValueState("times", "wake long, due long")

    def set_due(self, wake: int | None, first: int | None, due: int | None = None) -> None:
        """Remembers the waking time, and has a timer at the first thing that waits."""
        soonest = min((t for t in (wake, first) if t is not None), default=None)
        if soonest is not None and (due is None or soonest < due):
            self.handle.registerTimer(soonest)
            due = soonest
        self.times.update((wake, due))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        state, wake = self.rule.begun(initialState)
        self.known.update(state)
        self.set_due(wake, None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r["_us"], r["_nth"], *(r[n] for n in self.what)) for r in rows]
        self.waiting.appendList(new)
        wake, due = self.times.get() if self.times.exists() else (None, None)
        self.set_due(wake, min(t[0] for t in new) // 1000 + 1, due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda t: (t[0], t[1])) if self.waiting.exists() else []
        ready = [t for t in waiting if t[0] < now * 1000]
        wake, _ = self.times.get()
        state = self.known.get() if self.known.exists() else self.rule.start
        out: list[tuple] = []

        def woken(upto: int) -> None:
            nonlocal state, wake
            while wake is not None and wake * 1000 <= upto:
                state, rows, wake = self.rule.timer(state, wake)
                out.extend(rows)

        for us, _, *what in ready:
            woken(us)
            state, rows, next_ = self.rule.event(state, us, tuple(what))
            wake = wake if next_ == -1 else next_
            out.extend(rows)
        woken(now * 1000)
        self.known.update(state)
        if ready:
            if len(ready) < len(waiting):
                self.waiting.put(waiting[len(ready) :])
            else:
                self.waiting.clear()
        self.set_due(wake, waiting[len(ready)][0] // 1000 + 1 if len(ready) < len(waiting) else None)
        names = [self.key, *(f.split()[0] for f in self.rule.out.split(", "))]
        return iter([Row(**dict(zip(names, (*tuple(key), *row)))) for row in out])

    def close(self) -> None:
        pass


def in_order(events: DataFrame, rule: Rule, key: str, time: str, id_: str, late: str, what: dict[str, Column], initial: DataFrame | None = None) -> DataFrame:
    """``rule`` over a stream: the key and the rule's rows. late: how long stragglers are waited for. initial: key and what the rule begins with."""
    rows = events.withWatermark(time, late)
    rows = rows.select(key, time, F.unix_micros(F.col(time)).alias("_us"), F.col(id_).cast("long").alias("_nth"), *(c.alias(f"_{n}") for n, c in what.items()))
    waits = "_us long, _nth long, " + ", ".join(f"_{n} {rows.schema[f'_{n}'].dataType.simpleString()}" for n in what)
    out = f"{key} {rows.schema[key].dataType.simpleString()}, {rule.out}"
    begin = initial.groupBy(key) if initial is not None else None
    return rows.groupBy(key).transformWithState(InOrder(rule, key, [f"_{n}" for n in what], waits), out, "Append", "EventTime", begin)


class Queue(StatefulProcessor):
    """ST6: the newest ``n`` of a subscriber's messages; at each change what the queue holds, and how many it has dropped."""

    def __init__(self, n: int, key: str, order: str):
        self.n, self.key, self.order = n, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "id long")
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ids = sorted([t[0] for t in self.held.get()] if self.held.exists() else [])
        gone = self.dropped.get()[0] if self.dropped.exists() else 0
        for r in rows:
            ids.append(r[self.order])
            if len(ids) > 2 * self.n:
                ids = sorted(ids)[-self.n :]
                gone += self.n + 1
        gone += max(0, len(ids) - self.n)
        ids = sorted(ids)[-self.n :]
        self.held.put([(i,) for i in ids])
        self.dropped.update((gone,))
        yield Row(**{self.key: key[0], "held": ids, "dropped": gone})

    def close(self) -> None:
        pass


def newest_stream(events: DataFrame, subscriber: str, order: str, n: int) -> DataFrame:
    """subscriber, held, dropped: a row each time a queue changes; the last of a subscriber is what the queue holds (that with the most held and dropped)."""
    out = f"{subscriber} {events.schema[subscriber].dataType.simpleString()}, held array<long>, dropped long"
    return events.select(subscriber, F.col(order).cast("long").alias(order)).groupBy(subscriber).transformWithState(Queue(n, subscriber, order), out, "Update", "None")
