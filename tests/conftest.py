import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    from chronospan.session import build

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config(
        "spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))
    ).config("spark.ui.showConsoleProgress", "false")
    s = build("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
