import pytest

from siltstone.session import drop_own_dir, local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    drop_own_dir(s)
    s.stop()
