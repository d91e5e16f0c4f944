import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from glycospark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, 4, str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """Make a series frame from a dict of columns; ``datetime`` from strings or minutes."""

    def make(p_num="a", start="2024-01-01", step_min=5, **cols):
        n = len(next(iter(cols.values())))
        pdf = pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in cols.items()})
        if "datetime" not in pdf:
            pdf["datetime"] = pd.date_range(start, periods=n, freq=f"{step_min}min")
        pdf["datetime"] = pd.to_datetime(pdf["datetime"].astype(str), format="ISO8601")
        pdf["p_num"] = p_num
        pdf["pos"] = range(n)
        rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)]
        rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
        kinds = {"datetime": "timestamp_ntz", "p_num": "string", "pos": "bigint", "msg_type": "string"}
        schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf.columns)
        rows = [tuple(float(v) if schema.split(", ")[i].endswith("double") and v is not None else v for i, v in enumerate(r)) for r in rows]
        return spark.createDataFrame(rows, schema)

    return make


def values(df, col, order="datetime"):
    return [r[0] for r in df.orderBy("p_num", order).select(col).collect()]
