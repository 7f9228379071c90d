"""What the tests share."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(df) -> list[tuple]:
    """Rows of a pandas frame in an order and form that do not depend on the engine."""
    import pandas as pd

    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: None if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))
