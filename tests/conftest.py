import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from check_oracles import session

    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture
def fails():
    """Runs a DataFrame and returns the text of its error."""

    def run(df):
        with pytest.raises(Exception) as caught:
            df.collect()
        return str(caught.value)

    return run
