import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("VELLUM_DRIVER_MEMORY", "4g")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vellum.session import get_spark

    return get_spark(4, "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def sf():
    return SF
