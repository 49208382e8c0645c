"""Keyed state machines for ``transformWithStateInPandas``.

Rows of a key arrive unordered inside a micro-batch, so each processor sorts what the batch
brought (its size is set by the trigger) and then folds it into its state.

A call for a key costs far more than the rows of a small key, so where keys are many and small, rows
are grouped by ``slot``, a hash of the key, and a call folds all keys of its slot; a slot's state is read
and written once per micro-batch that brings it rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _batch(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


def _some(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows, if there are any: an empty frame with text columns cannot be handed back."""
    if len(rows):
        yield rows


class Delivery(StatefulProcessor):
    """Rows above every earlier sequence of their run, for the runs of a slot.

    What a subscriber has been sent depends on the run alone, so the highest sequence of each run is
    the whole state, however many subscribers follow it. A call takes all runs of a slot.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "runs array<string>, tops array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, "arrival").reset_index(drop=True)
        held = dict(zip(*self.held.get())) if self.held.exists() else {}
        codes, runs = pd.factorize(batch["run_id"])
        lowest = np.iinfo("int64").min
        known = np.array([held.get(r, lowest) for r in runs], dtype="int64")
        before = batch["seq"].groupby(codes).cummax().groupby(codes).shift(fill_value=lowest)
        sent = batch[batch["seq"] > before.clip(lower=pd.Series(known[codes]))]
        tops = batch["seq"].groupby(codes).max().dropna()
        for code, top in tops.items():
            held[runs[code]] = max(int(known[code]), int(top))
        self.held.update((list(held), [int(t) for t in held.values()]))
        yield from _some(sent[["run_id", "arrival", "seq"]])

    def close(self) -> None:
        pass


DELIVERY_SCHEMA = "run_id string, arrival long, seq long"


class RequestAdmission(StatefulProcessor):
    """Idempotent admission per (key, endpoint) with an expiry anchored at acceptance.

    Every batch that moves the anchor sets a timer behind its expiry; the timer that fires for the
    anchor held drops the state.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "ms long, seq long, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, "seq")
        held = self.anchor.get() if self.anchor.exists() else None
        held = before = (int(held[0]), int(held[1]), held[2]) if held else None
        decisions, anchors = [], []
        for seq, ms, digest, valid in zip(batch["seq"], batch["ms"], batch["hash"], batch["valid"]):
            live = held is not None and ms <= held[0] + self.ttl_ms
            if live:
                decisions.append("replay" if digest == held[2] else "conflict")
            elif valid:
                held = (int(ms), int(seq), digest)
                decisions.append("accepted")
            else:
                decisions.append("rejected")
            anchors.append(held[1] if live or valid else None)
        if held != before:
            self.anchor.update(held)
            self.handle.registerTimer(held[0] + self.ttl_ms + 1)
        out = pd.DataFrame({"key": key[0], "seq": batch["seq"].to_numpy(), "decision": decisions})
        yield out.assign(anchor_seq=pd.array(anchors, dtype="Int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if self.anchor.exists() and int(self.anchor.get()[0]) + self.ttl_ms < expired:
            self.anchor.clear()
        yield from ()

    def close(self) -> None:
        pass


REQUEST_SCHEMA = "key string, seq long, decision string, anchor_seq long"


class KvQuota(StatefulProcessor):
    """Live key sizes of a namespace and quota decisions for its changes."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "bytes long")
        self.sizes = handle.getMapState("sizes", "k string", "bytes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, "ord")
        used = int(self.used.get()[0]) if self.used.exists() else 0
        held: dict[str, int] = {}  # sizes touched in this batch
        decisions = []
        for k, op, size, check in zip(batch["k"], batch["op"], batch["size"], batch["check"]):
            if check != "ok":
                decisions.append(check)
                continue
            if k not in held:
                held[k] = int(self.sizes.getValue((k,))[0]) if self.sizes.containsKey((k,)) else 0
            new = 0 if op == "delete" else int(size)
            if op != "delete" and used + new - held[k] > self.limit:
                decisions.append("quota_exceeded")
                continue
            used, held[k] = used + new - held[k], new
            decisions.append("ok")
        for k, size in held.items():
            if size:
                self.sizes.updateValue((k,), (size,))
            elif self.sizes.containsKey((k,)):
                self.sizes.removeKey((k,))
        self.used.update((used,))
        out = pd.DataFrame({"namespace": key[0], "ord": batch["ord"].to_numpy(), "decision": decisions})
        yield from _some(out)

    def close(self) -> None:
        pass


KV_SCHEMA = "namespace string, ord long, decision string"


class LineAssembly(StatefulProcessor):
    """Complete lines of the (run, channel) streams of a slot; open remainders stay in state.

    A chunk flagged ``last`` flushes the remainder.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState(
            "open", "runs array<long>, channels array<string>, numbers array<long>, texts array<string>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, "seq")
        held = {}
        if self.open.exists():
            runs, channels, *values = self.open.get()
            held = dict(zip(zip(runs, channels), zip(*values)))
        arrived: dict[tuple, list[str]] = {}
        ended = set()
        ids = [None if pd.isna(r) else int(r) for r in batch["run_id"]]
        for run, channel, chunk, last in zip(ids, batch["channel"], batch["chunk"], batch["last"]):
            arrived.setdefault((run, channel), []).append(chunk)
            if last:
                ended.add((run, channel))
        out = []
        for stream, chunks in arrived.items():
            number, carry = held.get(stream, (0, ""))
            pieces = (carry + "".join(chunks)).split("\n")
            carry = pieces.pop()
            if stream in ended and carry:
                pieces.append(carry)
                carry = ""
            held[stream] = (int(number) + len(pieces), carry)
            out += [(*stream, int(number) + i, line) for i, line in enumerate(pieces)]
        columns = [*zip(*held), *zip(*held.values())]
        self.open.update(tuple(list(c) for c in columns))
        found = pd.DataFrame(out, columns=["run_id", "channel", "line_no", "line"])
        yield from _some(found.astype({"run_id": "Int64"}))

    def close(self) -> None:
        pass


LINE_SCHEMA = "run_id long, channel string, line_no long, line string"


class RecentEvents(StatefulProcessor):
    """Bounded recent events of a run; emits the sequences held after each batch."""

    def __init__(self, max_events: int, retention_ms: int) -> None:
        self.max_events, self.retention_ms = max_events, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, "seq")
        old = [(int(s), int(m)) for s, m in self.held.get()] if self.held.exists() else []
        # an add sees at most max_events held rows plus its own
        events = (old + list(zip(batch["seq"].astype(int), batch["ms"].astype(int))))
        events = events[-(self.max_events + 1):]
        cutoff = events[-1][1] - self.retention_ms
        start = next(i for i, (_, ms) in enumerate(events) if ms >= cutoff)
        events = [(int(s), int(m)) for s, m in events[start:][-self.max_events:]]
        self.held.put(events)
        out = pd.DataFrame({"run_id": key[0], "newest": events[-1][0], "seq": [s for s, _ in events]})
        yield from _some(out)

    def close(self) -> None:
        pass


RECENT_SCHEMA = "run_id string, newest long, seq long"
