import pytest

from folioflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(4, 4)
