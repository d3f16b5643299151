import os
import sys
from datetime import date, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hindcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """`frame(schema, *tuples)`; texts become dates or timestamps where the schema says so."""

    def build(schema, *rows):
        kinds = [part.strip().split()[1] for part in schema.split(",")]
        read = {"timestamp_ntz": datetime.fromisoformat, "date": date.fromisoformat}
        data = [
            tuple(read[k](v) if k in read and isinstance(v, str) else v for k, v in zip(kinds, row)) for row in rows
        ]
        return spark.createDataFrame(data, schema)

    return build


def tuples(df, *columns):
    """Rows as sorted tuples, dates as text."""
    picked = df.select(*columns) if columns else df
    plain = lambda v: v.isoformat(sep=" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, date) else v
    return sorted((tuple(plain(v) for v in row) for row in picked.collect()), key=lambda r: tuple(map(repr, r)))
