"""Persistent sessions as keyed state: attach, detach, delete, subscribe, unsubscribe and expire.

A session's requests are replayed in order against its state, on a table by
tasks that read their sessions one after the other and on a stream by state
that lives from one batch to the next.  The same small fold serves both.

A request row has: id (order, and the incarnation that it creates), inbox, op,
filter, qos, ms, expiry (seconds) and stale (it carries another version than
the session's).  The reply has the code and the state after it; a deleted
session's reply tells the filters it had.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.messages import dealt

REPLY = "id long, inbox long, op string, code string, incarnation long, mod long, expiry long, detached long, filters string"
STATE = "session string"
ORDER = ["id", "inbox", "op", "filter", "qos", "ms", "expiry", "stale"]


def replay(session: dict | None, requests: Iterator[tuple], most: int) -> tuple[dict | None, list[tuple]]:
    """Replies to requests in order, and the session after them."""
    out = []
    for id_, inbox, op, filter_, qos, ms, expiry, stale in requests:
        gone = session is not None and None not in (session["detached"], session["expiry"], ms) and session["detached"] + session["expiry"] * 1000 < ms
        told = None
        if op == "attach":
            if session is not None and not gone:
                code, session = "REUSED", session | {"mod": session["mod"] + 1, "expiry": expiry, "detached": None}
            elif expiry == 0:
                code = "TRANSIENT"  # leaves no session behind, and none alone
            else:
                code, session = "CREATED", {"incarnation": id_, "mod": 0, "expiry": expiry, "detached": None, "filters": {}}
        elif session is None:
            code = "NO_INBOX"
        elif op == "expire":
            code, told, session = ("OK", session["filters"], None) if gone else ("KEPT", None, session)
        elif stale:
            code = "CONFLICT"
        elif op == "detach":
            code, session = "OK", session | {"mod": session["mod"] + 1, "expiry": expiry, "detached": ms}
        elif op == "delete":
            code, told, session = "OK", session["filters"], None
        elif op == "sub":
            if len(session["filters"]) >= most:  # also for a filter that is there already
                code = "EXCEED_LIMIT"
            elif session["filters"].get(filter_) == qos:
                code = "EXISTS"
            else:
                code, session = "OK", session | {"filters": session["filters"] | {filter_: qos}}
        else:
            code = "OK" if filter_ in session["filters"] else "NO_SUB"
            session = session | {"filters": {k: v for k, v in session["filters"].items() if k != filter_}}
        filters = told if told is not None else session["filters"] if session else {}
        told_filters = ",".join(f"{k}={v}" for k, v in sorted(filters.items()))
        now = session or {}
        out.append((id_, inbox, op, code, now.get("incarnation"), now.get("mod"), now.get("expiry"), now.get("detached"), told_filters))
    return session, out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in REPLY.split(", ")]
    made = pd.DataFrame(rows, columns=names)
    return made.astype({n: "Int64" for n in ("id", "inbox", "incarnation", "mod", "expiry", "detached")})


KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def folded(rows: DataFrame, key: str, columns: list[str], fold: Callable, schema: str, last: bool = False) -> DataFrame:
    """What ``fold`` makes of each key's rows, ``columns`` in order of the first: (state or None, rows) to (state, results).

    A task reads its keys one after the other and holds one batch of rows and the
    state of one key.  With ``last`` only the last result of each key is passed on.
    """
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    at = columns.index(key)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, held = None, (), []
        for batch in batches:
            out = []
            for value, asked in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), itemgetter(at)):
                if (value,) != now:
                    state, now, out, held = None, (value,), out + held, []
                state, made = fold(state, asked)
                if last:
                    held = made[-1:]
                else:
                    out += made
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(held)

    return dealt(rows.select(*columns), key).sortWithinPartitions(key, F.col(columns[0]).asc_nulls_last()).mapInArrow(run, schema)


def replies(requests: DataFrame, most: int) -> DataFrame:
    """The reply to each request of a table."""
    return folded(requests, "inbox", ORDER, lambda session, asked: replay(session, asked, most), REPLY)


def streamed_replies(requests: DataFrame, most: int) -> DataFrame:
    """The reply to each request of a stream; a session's requests must come in order from batch to batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("id")
        session, made = replay(session, rows[ORDER].itertuples(index=False, name=None), most)
        if session is None:
            state.remove() if state.exists else None
        else:
            state.update((json.dumps(session),))
        yield _frame(made)

    return requests.select(*ORDER).groupBy("inbox").applyInPandasWithState(run, REPLY, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_sessions(requests: DataFrame, most: int) -> DataFrame:
    """Each inbox's state after its last request: only those that have a session then."""
    last = folded(requests, "inbox", ORDER, lambda session, asked: replay(session, asked, most), REPLY, last=True)
    return last.where("incarnation is not null").select("inbox", "incarnation", "mod", "expiry", "detached", "filters")


def expired(detached: str, expiry: str, now_ms: int):
    return F.coalesce(F.col(detached) + F.col(expiry) * 1000 < now_ms, F.lit(False))


ALIAS = "id long, alias long, fresh boolean"


def aliased(topics: Iterator[tuple[int, str]], most: int, held: dict | None = None) -> list[tuple[int, int, bool]]:
    """The alias that a sender gives each topic in order: a new one while there are any, else that of the topic used least, the lower alias among equals.

    ``held`` has topic: [times, alias] so far, and is kept up to date.
    """
    out, held = [], {} if held is None else held
    for id_, topic in topics:
        fresh = topic not in held
        if fresh and len(held) < most:
            held[topic] = [1, len(held) + 1]
        elif fresh:
            least = min(held, key=held.get)
            held[topic] = [1, held.pop(least)[1]]
        else:
            held[topic][0] += 1
        out.append((id_, held[topic][1], fresh))
    return out


def sender_aliases(sent: DataFrame, client: str, most: int) -> DataFrame:
    """Adds to each publish (id, topic) of a client its alias and whether the topic goes with it; a connection's publishes are one group."""

    def fold(held: dict | None, rows: Iterator[tuple]) -> tuple[dict, list[tuple]]:
        held = {} if held is None else held
        return held, aliased(((id_, topic) for id_, _, topic in rows), most, held)

    return folded(sent, client, ["id", client, "topic"], fold, ALIAS)
