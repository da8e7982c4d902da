"""Streams against the batch operators."""

import pandas as pd
from support import TINY

from gristmill.operators import review as rv
from gristmill.plans import streams
from gristmill.session import table


def test_sessions(spark):
    got = streams.events_idle_stream(spark, TINY).toPandas()
    batch = rv.sessions(table(spark, TINY, "events"), ["user_id"], "ts").toPandas()
    closed = {(r.user_id, r.first, r.n) for r in got.itertuples()}
    every = {(r.user_id, r.first, r.n) for r in batch.itertuples()}
    assert closed <= every and len(closed) > 0.9 * len(every)


def test_undo(spark):
    got = streams.undo_stream(spark, TINY).toPandas().set_index("user_id")
    for user, rows in table(spark, TINY, "events").toPandas().sort_values(["ts", "event_id"]).groupby("user_id"):
        stack = []
        for e, v in zip(rows.event_id, rows.value, strict=True):
            stack = stack[:-1] if e % 5 == 0 else [*stack, v]
        assert got.depth[user] == len(stack)
        assert got.value[user] == stack[-1] if stack else pd.isna(got.value[user])
