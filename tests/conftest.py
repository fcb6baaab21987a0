import pytest

from larkspur.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "larkspur-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
