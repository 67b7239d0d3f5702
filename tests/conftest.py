import pytest

from palimpsest.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
