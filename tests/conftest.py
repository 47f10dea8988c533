import pytest

from drayline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "3g")
    yield session
    session.stop()
