import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from logspark.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=str(shared), spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(tmp_path):
    def write(text, name="test.log"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return write
