import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docustrata.session import get_spark

    made = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    made.sparkContext.setLogLevel("OFF")
    yield made
    made.stop()
