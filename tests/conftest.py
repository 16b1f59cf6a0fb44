import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcast.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = get_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": folder},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Three series with gaps, holes and one short series; rows in shuffled order."""
    import datetime as dt
    import random

    rnd = random.Random(5)
    rows = []
    for uf, n in (("A", 400), ("B", 150), ("C", 5)):
        for i in range(n):
            if rnd.random() < 0.15:
                continue
            date = dt.date(2001, 1, 7) + dt.timedelta(weeks=i)
            value = rnd.randint(0, 50)
            hole = None if rnd.random() < 0.3 else float(rnd.randint(0, 30))
            rows.append((uf, date, value, hole))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "uf string, date date, casos bigint, x double")
