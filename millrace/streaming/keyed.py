"""State of many values a key, with timers: the stack of waiting parents, and calls put together from fragments.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). State is one row for each value, so a key's
state isn't read or written whole for each event, and what nobody takes up is given back when its time is over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POPPED = "session_id string, task_id string, outcome string, depth long"
CALLS = "stream string, idx long, id string, name string, arguments string, outcome string"


def _ms(at) -> int:
    return int(at.timestamp() * 1000)


class _Stack(StatefulProcessor):
    """Tasks that wait for a session, the newest on top."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stack = handle.getListState("stack", "task_id string, pushed long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(x) for x in self.stack.get()]
        before = list(held)
        for r in sorted(rows, key=lambda r: (r.event_time, r.seq)):
            if r.op == "push":
                held.append((r.task_id, _ms(r.event_time)))
                self.handle.registerTimer(_ms(r.event_time) + self.ttl)
            elif held:
                task, _ = held.pop()
                yield Row(session_id=key[0], task_id=task, outcome="popped", depth=len(held))
            else:
                yield Row(session_id=key[0], task_id=None, outcome="empty", depth=0)
        if held != before:
            self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(x) for x in self.stack.get()]
        stays = [x for x in held if x[1] + self.ttl > now]
        for task, pushed in held:
            if pushed + self.ttl <= now:
                yield Row(session_id=key[0], task_id=task, outcome="expired", depth=len(stays))
        if len(stays) < len(held):
            self._keep(stays)

    def _keep(self, held: list[tuple]) -> None:
        if held:
            self.stack.put(held)
        else:
            self.stack.clear()

    def close(self) -> None:
        pass


def waiting(events: DataFrame, ttl: int, delay: str = "0 seconds") -> DataFrame:
    """What becomes of waiting tasks: (session_id, event_time, seq, op push or pop, task_id) -> (session_id, task_id, outcome, depth).

    A pop takes the newest task of its session (``popped``), or none (``empty``); a task that nobody takes within
    ``ttl`` seconds of event time is given up (``expired``), once. depth is what is left on the stack.
    """
    marked = events.withWatermark("event_time", delay)
    return marked.groupBy("session_id").transformWithState(_Stack(ttl), POPPED, "Append", "EventTime")


class _Calls(StatefulProcessor):
    """Fragments of one stream by number."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq long", "idx long, id string, name string, arguments string")
        self.total = handle.getValueState("total", "seen long, top long, end long, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seen, top, end, done = self.total.get() if self.total.exists() else (0, -1, -1, False)
        latest = 0
        for r in rows:
            latest = max(latest, _ms(r.event_time))
            if done:
                continue
            if not self.parts.containsKey((r.seq,)):
                self.parts.updateValue((r.seq,), (r.idx, r.id, r.name, r.arguments))
                seen, top = seen + 1, max(top, r.seq)
            if r.last:
                end = max(end, r.seq)
        if not done and top == end and seen == end + 1 > 0:
            yield from self._calls(key[0], "whole")
            self.parts.clear()
            done = True
        self.total.update((seen, top, end, done))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(latest + self.ttl, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.total.exists():
            if not self.total.get()[3]:
                yield from self._calls(key[0], "broken")
            self.parts.clear()
            self.total.clear()

    def _calls(self, stream: str, outcome: str) -> Iterator[Row]:
        by: dict[int, list[str]] = {}
        for _, (idx, id_, name, arguments) in sorted((k[0], tuple(v)) for k, v in self.parts.iterator()):
            if idx is not None:
                call = by.setdefault(idx, ["", "", ""])
                call[0] = id_ or call[0]
                call[1] += name or ""
                call[2] += arguments or ""
        for idx, (id_, name, arguments) in sorted(by.items()):
            yield Row(stream=stream, idx=idx, id=id_, name=name, arguments=arguments, outcome=outcome)

    def close(self) -> None:
        pass


def assembled(fragments: DataFrame, ttl: int, delay: str = "0 seconds") -> DataFrame:
    """The stream of ``operators.fragments.assembled``: adds event_time to what comes in, outcome to what goes out.

    Calls go out once, when the last of their fragments is in (``whole``). A stream that is still not whole ``ttl`` seconds
    after its newest fragment goes out as far as it came (``broken``); one that is whole is remembered as long, so that
    fragments that come again make no second call.
    """
    marked = fragments.withWatermark("event_time", delay).withColumn("idx", F.col("idx").cast("long"))
    return marked.groupBy("stream").transformWithState(_Calls(ttl), CALLS, "Append", "EventTime")
