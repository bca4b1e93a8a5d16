import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    # Plans over a few rows: compiling them costs more than running them.
    s = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "false").config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
