"""A limiter for streams: calls of one key are given times that are far enough apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PACED = "{key} {kind}, call_id long, at_us long"


def paced(calls: DataFrame, key: str, gap: int, call_id: str = "event_id", ts: str = "ts") -> DataFrame:
    """``key, call_id, at_us`` of a stream of calls: when each may go, ``gap`` microseconds after the one before it and not before it came.

    The state of a key is one number, when its next call may go. Within a batch calls are taken in their order; a call that
    comes in a later batch goes after those that came before it.
    """

    def run(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = sorted((int(t.value // 1000), int(c)) for b in batches for t, c in zip(b[ts], b[call_id]))
        out = []
        for came, call in rows:
            at = came if free is None else max(came, free)
            out.append((who[0], call, at))
            free = at + gap
        state.update((free,))
        yield pd.DataFrame(out, columns=[key, "call_id", "at_us"])

    kind = calls.schema[key].dataType.simpleString()
    return calls.select(key, call_id, ts).groupBy(key).applyInPandasWithState(run, PACED.format(key=key, kind=kind), "free long", "append", GroupStateTimeout.NoTimeout)
