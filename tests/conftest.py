import pytest

from smoothspan.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__sql__adaptive__coalescePartitions__enabled="true"
    )


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
