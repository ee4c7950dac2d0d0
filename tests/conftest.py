import pytest

from graphloom.session import checkpoint_folder, local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_folder(session)
    ship_package(session)
    yield session
    session.stop()
