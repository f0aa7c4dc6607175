import pytest

from tractloom.functions.geometry import Grid
from tractloom.session import local_session

IDENTITY = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests", shuffle_partitions=2, memory="4g")


@pytest.fixture(scope="session")
def grid():
    return Grid(IDENTITY, (10, 10, 10))


@pytest.fixture(scope="session")
def make_points(spark):
    def make(lines, subject=0):
        rows = [(subject, sid, n, float(x), float(y), float(z)) for sid, line in lines.items() for n, (x, y, z) in enumerate(line)]
        return spark.createDataFrame(rows, "subject_id long, streamline_id long, pt_idx int, x double, y double, z double")
    return make


@pytest.fixture(scope="session")
def ramp(spark):
    """10^3 map with value k/9 in all four scalars."""
    from pyspark.sql import functions as F
    v = spark.range(1000).selectExpr("0L subject_id", "cast(id div 100 as int) i", "cast((id div 10) % 10 as int) j", "cast(id % 10 as int) k")
    return v.withColumns({c: F.col("k") / 9.0 for c in ("fa", "md", "rd", "ad")})
