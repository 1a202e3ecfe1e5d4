"""Operators that keep state per key between micro-batches.

Both run in event time: a key's rows are judged in the order of their time, state goes by
timers as the watermark moves on, and rows that come behind the watermark are not dropped
but marked ``late``.  A batch step over what the stream has landed then gives the exact
result for the keys that had late rows, see ``twinlabel.operators.repeats`` and
``twinlabel.operators.timeline``.

Keys share ``BUCKETS`` groups by hash: a call and an exchange with the state store per group
and micro-batch, not per key.  Rows of a group in a micro-batch are ordered in memory, so only
narrow columns come here, and the source's limits bound a micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..constants import PROVIDER_CODES

KEPT, DROPPED, LATE = "kept", "dropped", "late"
_AT = "at_micros"  # rows come as named tuples, whose names may not start with "_"
_NAME = "key_name"
# Groups of keys; a checkpoint holds for one number only.
BUCKETS = 1024


def micros(interval: str) -> int:
    return pd.Timedelta(interval).value // 1000


def _stateful(rows: DataFrame, keys: list[str], ts: str, late: str, processor, schema: str,
              buckets: int) -> DataFrame:
    """``processor`` per group of keys, in event time.  The time goes along as a number, so that
    the engine leaves rows behind the watermark to the processor.  Keys with nulls are apart, as
    whole numbers beside nulls would not stay whole in pandas."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    nulls = F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in keys])
    micro = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    name = F.to_json(
        F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]),
        {"timestampFormat": f"{micro}XXX", "timestampNTZFormat": micro},
    )
    return (
        rows.withWatermark(ts, late)
        .withColumns({
            _AT: at, _NAME: name, "key_nulls": nulls,
            "key_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)),
        })
        .drop(ts)
        .groupBy("key_bucket", "key_nulls")
        .transformWithStateInPandas(processor, schema, "Append", "EventTime")
    )


def _ddl(schema: StructType, names: Iterable[str]) -> str:
    return ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in names)


def _watermark(timers) -> int:
    return timers.getCurrentWatermarkInMs() * 1000


class KeepFirst(StatefulProcessor):
    """Judges rows by the last kept time of their key, the only state: one row per group.

    A key's time goes once the watermark has passed the end of the bound: what follows on time is
    then kept whatever the state was.
    """

    def __init__(self, keys: list[str], order: list[str], within: int):
        self.keys, self.order, self.within = keys, order, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "names array<string>, at array<long>")

    def _known(self, bound: int) -> dict[str, int]:
        """Last kept times that still matter."""
        if not self.last.exists():
            return {}
        names, ats = self.last.get()
        return {n: at for n, at in zip(names, ats) if at + self.within >= bound}

    def _keep(self, known: dict[str, int]) -> None:
        if known:
            self.last.update((list(known), list(known.values())))
        else:
            self.last.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values([_AT, *self.order], kind="stable")
        bound, outcomes, newest = _watermark(timerValues), [], None
        known = self._known(bound)
        for name, at in zip(part[_NAME].tolist(), part[_AT].tolist()):
            last = known.get(name)
            if pd.isna(at):
                outcomes.append(KEPT)
            elif at < bound or (last is not None and at < last):
                outcomes.append(LATE)
            elif last is not None and at < last + self.within:
                outcomes.append(DROPPED)
            else:
                known[name] = newest = int(at)
                outcomes.append(KEPT)
        if newest is not None:
            self._keep(known)
            # Rows come in order of time, so the bounds of all others end before.
            self.handle.registerTimer((newest + self.within) // 1000 + 1)
        part["outcome"] = outcomes
        part[_AT] = part[_AT].astype("Int64")
        yield part[[*self.keys, *self.order, _AT, "outcome"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Later requests may have moved the end of the bound, with a timer of their own.
        if self.last.exists():
            self._keep(self._known(_watermark(timerValues)))
        return iter(())

    def close(self) -> None:
        pass


def judged_requests(requests: DataFrame, key: Iterable[str] = ("request_key",), ts: str = "ts",
                    order: Iterable[str] = ("request_id",), within: str = "10 minutes",
                    late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Every request of a stream with an ``outcome``: ``kept``, ``dropped`` if it lies within
    ``within`` of its key's last kept one, or ``late`` if it is more than ``late`` behind the
    newest request of all, or behind the last kept one of its key.

    Columns are those of ``key`` and ``order``, ``ts`` and ``outcome``.  A request without a time
    is kept.  Requests at one time are judged in the order of ``order``.
    """
    keys, order = list(key), list(order)
    rows = requests.select(*keys, *order, ts)
    schema = f"{_ddl(rows.schema, [*keys, *order])}, {_AT} long, outcome string"
    judged = _stateful(rows, keys, ts, late, KeepFirst(keys, order, micros(within)), schema, buckets)
    return judged.select(*keys, *order, F.timestamp_micros(_AT).alias(ts), "outcome")


class SessionState(StatefulProcessor):
    """What a session shows after each of its events, in the order of event time.

    Events wait in the state until the watermark has passed them.  A timer stands for the oldest
    one of the group that waits; with ``idle``, another one for the session that is the first to
    have been without events for so long.  What waits is stored a micro-batch at a time.
    """

    def __init__(self, session: str, providers: tuple[str, ...], idle: int | None):
        self.session, self.providers, self.idle = session, providers, idle
        self.shown = [f"{p}_{kind}" for p in providers for kind in ("result", "error")]
        self.places = {p: 2 * i for i, p in enumerate(providers)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Per session the time of its last event, its image and what is shown.
        self.state = handle.getValueState("sessions", "sessions binary")
        self.waiting = handle.getListState("waiting", "events binary")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = [self.session, "event_id", "image", *self.shown, "outcome"]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bound, waits, late = _watermark(timerValues), [], []
        for part in rows:
            part = part[
                [_AT, self.session, "event_id", "image_seq", "provider", "kind", "result", "error"]
            ]
            part = part.astype(object).where(part.notna(), None)
            for row in part.itertuples(index=False, name=None):
                if row[0] is None or row[0] < bound:
                    late.append((row[1], row[2], None, *[None] * len(self.shown), LATE))
                else:
                    waits.append(row)
        if waits:
            self.waiting.appendValue((pickle.dumps(waits),))
            self.handle.registerTimer(int(min(w[0] for w in waits)) // 1000 + 1)
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bound = _watermark(timerValues)
        chunks = [pickle.loads(c[0]) for c in self.waiting.get()] if self.waiting.exists() else []
        waits = [w for chunk in chunks for w in chunk]
        due = sorted((w for w in waits if w[0] < bound), key=lambda w: (w[0], w[2]))
        left = [w for w in waits if w[0] >= bound]
        sessions = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        known, out, blank = len(sessions), [], [None] * len(self.shown)
        for at, session, event, image_seq, provider, kind, result, error in due:
            _, image, shown = sessions.get(session) or (None, None, blank)
            if image_seq is not None and (image is None or image_seq > image):
                image, shown = image_seq, blank
            place = self.places.get(provider)
            if image_seq is not None and image_seq == image and place is not None:
                if kind == "ok":
                    shown = [*shown[:place], result, *shown[place + 1 :]]
                elif kind in ("start", "error"):
                    shown = [*shown[: place + 1], error if kind == "error" else None, *shown[place + 2 :]]
            sessions[session] = at, image, shown
            out.append((session, event, image, *shown, KEPT))
        if self.idle is not None:
            busy = {w[1] for w in due} | {w[1] for w in left}
            gone = [s for s, (at, *_) in sessions.items() if at + self.idle < bound and s not in busy]
            for session in gone:
                del sessions[session]
            ends = [at + self.idle for at, *_ in sessions.values()]
            # One that is over already had an event just now: it goes at the next turn.
            if ends:
                self.handle.registerTimer(int(max(min(ends), bound)) // 1000 + 1)
        if due:
            if left:
                self.waiting.put([(pickle.dumps(left),)])
            else:
                self.waiting.clear()
        if sessions and (due or len(sessions) != known):
            self.state.update((pickle.dumps(sessions),))
        elif known and not sessions:
            self.state.clear()
        if left:
            self.handle.registerTimer(int(min(w[0] for w in left)) // 1000 + 1)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def session_states(events: DataFrame, providers=PROVIDER_CODES, late: str = "1 hour",
                   idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """State of every session after each of its events, from a stream of events.

    Columns are session_id, event_id, image, per provider ``<p>_result`` and ``<p>_error``, and
    ``outcome``.  An event is shown once the newest event of all is more than ``late`` ahead of
    it, so events may come in any order within that; one that comes later is given back with
    the outcome ``late`` and an empty state.  A session without events for ``idle`` is forgotten.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    shown = ", ".join(f"{p}_result {types['result']}, {p}_error string" for p in providers)
    schema = (
        f"session_id {types['session_id']}, event_id {types['event_id']}, image long, "
        f"{shown}, outcome string"
    )
    processor = SessionState(
        "session_id", tuple(providers), None if idle is None else micros(idle)
    )
    rows = events.select(
        "session_id", "event_id", F.col("image_seq").cast("long").alias("image_seq"), "provider",
        "kind", "ts", "result", "error",
    )
    return _stateful(rows, ["session_id"], "ts", late, processor, schema, buckets)
