import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fundflow.session import get_spark, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4, app_name="fundflow-tests")
    # the session's spark.checkpoint.dir is used when set; otherwise shared_dir
    # registers a private scratch folder for this test run
    shared_dir(s)
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
