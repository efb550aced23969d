import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from terraload.runtime import new_path, ship_modules, work_dir  # noqa: E402
from terraload.session import local_session  # noqa: E402
from terraload.sources.tables import create_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    ship_modules(session)
    return session


@pytest.fixture
def folder(spark):
    path = Path(new_path(spark, "test"))
    path.mkdir(parents=True)
    return path


@pytest.fixture
def schema(spark):
    path = new_path(spark, "db")
    name = path[len(work_dir(spark)) + 1:].replace("-", "_")
    create_schema(spark, name, path)
    return name
