"""Results that are polled: one message for each change of a file, whatever is listed again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(listings: DataFrame, path: str, stamp: str, late: str = "10 minutes", keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream of listings (path, stamp: when the file was changed) -> path, stamp and n, how many changes of it have been
    met: a row for each stamp of a path that is later than all before it. Stamps of one batch are taken in their order.
    State is a stamp and a count for each path; it goes when event time has passed the path's last stamp by keep_ms, after
    which an old listing would count again, so keep_ms is longer than anything is listed late."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (None, 0)
        met = []
        for at in sorted({t for b in batches for t in b[stamp]}):
            us = at.value // 1000
            if last is None or us > last:
                last, n = us, n + 1
                met.append((key[0], at, n))
        state.update((last, n))
        # no earlier than the watermark, which a late path's stamp may be behind
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + keep_ms)
        if met:
            yield pd.DataFrame(met, columns=[path, stamp, "n"])

    kind = dict(listings.dtypes)[path]
    seen = listings.select(path, F.col(stamp).cast("timestamp").alias(stamp)).where(F.col(path).isNotNull() & F.col(stamp).isNotNull()).withWatermark(stamp, late)
    return seen.groupBy(path).applyInPandasWithState(fold, f"{path} {kind}, {stamp} timestamp, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
