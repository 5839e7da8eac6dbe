import pytest

from harvestlens.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", "4g", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
