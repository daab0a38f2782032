import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("NEWSLOOM_DRIVER_MEMORY", "6g")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from newsloom.session import session

    spark = session("tests", 8, 4)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
