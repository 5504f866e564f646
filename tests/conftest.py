import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from plumbline.session import local_session  # noqa: E402
from plumbline.sources import read_csv  # noqa: E402

DATA = ROOT / "tests" / "data"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    return read_csv(spark, str(DATA / "sales.csv"))


@pytest.fixture(scope="session")
def employees(spark):
    return read_csv(spark, str(DATA / "employees.csv"))
