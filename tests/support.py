"""Constants and comparisons that tests share."""

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    import math

    import numpy as np
    import pandas as pd

    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_cell, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return f"{float(x):.9g}"
    return x.isoformat() if isinstance(x, pd.Timestamp) else str(x)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False, name=None))
