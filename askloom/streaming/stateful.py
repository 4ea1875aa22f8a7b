"""Streams with state of their own per key: answers put together from events, repeated queries answered from earlier ones.

Both wait for the watermark where order matters: events of a key are held until no earlier
one can come, so results do not depend on how the events are cut into micro-batches. State
is what has arrived of an open response, or the events of one key within the watermark's
delay, and leaves with its timer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def _micros(ts: pd.Series) -> list[int]:
    return (ts - pd.Timestamp(0)).dt.total_seconds().mul(1e6).round().astype("int64").tolist()


def assembled_stream(events: DataFrame, response: list[str], delay: str = "1 hour", idle: str = "6 hours", parts: int = 64) -> DataFrame:
    """One row per response as soon as it is over: answer, citations, verdict, finished, ttft_ms, n_events.

    ``events``: the ``response`` columns, kind (meta, token, citation, verify, done),
    sequence (from 1 without gaps), ts, payload. A response is over when its ``done`` and
    every event before it are there, whatever their order; or when nothing has come for
    ``idle`` after its last event, by the watermark: then it leaves as it is, ``finished``
    if ``done`` was there. An event that comes twice counts once. Tokens and citations stand
    in the order of their sequence.

    Responses are dealt by hash into ``parts`` groups, so that Python is called per group and
    micro-batch, not per response. A group's state is the events of its open responses, each
    response with its own time limit; more parts mean smaller groups, results do not depend on it.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    of = dict(events.dtypes)
    told = ["answer", "citations", "verdict", "finished", "ttft_ms", "n_events"]
    # keys travel as text, so that nulls and large numbers stay exact
    out = ", ".join(f"{c} string" for c in response) + ", answer string, citations array<string>, verdict string, finished boolean, ttft_ms double, n_events bigint"
    held = ", ".join(f"k{i} array<string>" for i in range(len(response))) + ", sequence array<bigint>, kind array<string>, payload array<string>, at array<bigint>, due array<bigint>"

    def row(key: tuple, have: dict[int, tuple[str, str, int]]) -> tuple:
        told = [have[s] for s in sorted(have)]
        start, token = min(x[2] for x in told), min((x[2] for x in told if x[0] == "token"), default=None)
        verdicts = [x[1] for x in told if x[0] == "verify"]
        return (
            *key, "".join(x[1] or "" for x in told if x[0] == "token"), [x[1] for x in told if x[0] == "citation"], verdicts[-1] if verdicts else None,
            any(x[0] == "done" for x in told), None if token is None else (token - start) / 1000.0, len(told))

    def step(_: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have: dict[tuple, dict[int, tuple[str, str, int]]] = {}
        due: dict[tuple, int] = {}
        if state.exists:
            *keys, sequence, kinds, payloads, ats, dues = state.get
            for key, s, kind, payload, at, limit in zip(zip(*keys), sequence, kinds, payloads, ats, dues):
                have.setdefault(key, {})[s] = (kind, payload, at)
                due[key] = limit
        passed, rows, came = state.getCurrentWatermarkMs(), [], set()
        if not state.hasTimedOut:
            for part in batches:
                for key, s, kind, payload, at in zip(zip(*(part[c] for c in response)), part["sequence"], part["kind"], part["payload"], _micros(part["ts"])):
                    have.setdefault(key, {}).setdefault(int(s), (kind, payload, at))
                    came.add(key)
        for key in list(have):
            mine = have[key]
            if key in came:
                last = min((s for s, x in mine.items() if x[0] == "done"), default=None)
                over = last is not None and all(s in mine for s in range(1, last))
                due[key] = max(max(x[2] for x in mine.values()) // 1000 + idle_ms, passed + 1)
            else:
                over = due[key] < passed
            if over:
                rows.append(row(key, have.pop(key)))
                del due[key]
        if have:
            flat = [(*key, s, *have[key][s], due[key]) for key in have for s in sorted(have[key])]
            state.update(tuple(list(x) for x in zip(*flat)))
            state.setTimeoutTimestamp(max(min(due.values()), passed + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=[*response, *told])

    rows = events.select(
        F.pmod(F.xxhash64(*response), F.lit(parts)).alias("_part"), *[F.col(c).cast("string").alias(c) for c in response], "kind",
        F.col("sequence").cast("bigint").alias("sequence"), "ts", F.col("payload").cast("string").alias("payload"))
    over = rows.withWatermark("ts", delay).groupBy("_part").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return over.select(*[F.col(c).cast(of[c]).alias(c) for c in response], *told)


def cached_stream(requests: DataFrame, keys: list[str], ttl: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Each request with hit or miss: keys, id, ts, hit, answered_by.

    ``requests``: the key columns, id, ts. A request is answered by the earlier one of its
    key that was computed (a miss) at most ``ttl`` before; otherwise it is a miss and is
    computed itself. Hits do not prolong an entry. Requests are looked at in the order of
    (ts, id) once the watermark has passed them.
    """
    ttl_us = int(pd.Timedelta(ttl).total_seconds() * 1_000_000)
    of = dict(requests.dtypes)
    names = [*keys, "id", "ts", "hit", "answered_by"]
    out = ", ".join([*(f"{c} {of[c]}" for c in keys), f"id {of['id']}", "ts timestamp", "hit boolean", f"answered_by {of['id']}"])
    held = f"entry {of['id']}, entered bigint, waits array<{of['id']}>, at array<bigint>"

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, entered, waits, at = state.get if state.exists else (None, None, [], [])
        waits, at = list(waits), list(at)
        if not state.hasTimedOut:
            for part in parts:
                waits += part["id"].tolist()
                at += _micros(part["ts"])
        passed = state.getCurrentWatermarkMs() * 1000
        rows, rest = [], []
        for t, i in sorted(zip(at, waits)):
            if t >= passed:
                rest.append((t, i))
                continue
            hit = entered is not None and t - entered <= ttl_us
            if not hit:
                entry, entered = i, t
            rows.append((*key, i, pd.Timestamp(t, unit="us"), hit, entry))
        if not rest and (entered is None or entered + ttl_us < passed):
            state.remove() if state.exists else None  # the entry has expired for all that can come
        else:
            state.update((entry, entered, [i for _, i in rest], [t for t, _ in rest]))
            due = (rest[0][0] if rest else entered + ttl_us) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    rows = requests.select(*keys, "id", "ts").withWatermark("ts", delay)
    return rows.groupBy(*keys).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)
