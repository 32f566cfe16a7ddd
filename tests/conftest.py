import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    """A session for small tables: few partitions, and plans interpreted where compiling them would take longer than running."""
    from larkspur.plans.session import session

    return session(cpus=8, spark__sql__codegen__wholeStage="false", spark__sql__shuffle__partitions="4", spark__sql__sources__parallelPartitionDiscovery__parallelism="4")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
