import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from firmlens.session import drop_staged, local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()
