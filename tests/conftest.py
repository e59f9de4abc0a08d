"""One local session for all tests, with its own shared folder."""

import pytest

from tablemill.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("checkpoint")
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(shared),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
