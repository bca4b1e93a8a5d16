import pytest


@pytest.fixture(scope="session")
def spark(spark):
    """A session of its own with Spark's default settings: adaptive plans, generated code and several partitions."""
    s = spark.newSession()
    for k, v in {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        s.conf.set(k, v)
    return s
