import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.config import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[*]", app_name="cohortlens-tests", shuffle_partitions=8)
    # Tests only: a private checkpoint folder when the session names none.
    checkpoint_dir(session, fallback=tempfile.mkdtemp(prefix="cohortlens-ckpt-"))
    yield session
    session.stop()


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all columns if none given)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
