import pytest
from pyspark.sql import SparkSession

from reqsieve.plans.portable import PortableModel
from reqsieve.session import prepare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("reqsieve-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


@pytest.fixture(scope="session")
def fixed_model():
    return PortableModel(
        intercept=-1.2,
        numeric_weights={"rtbFloorPriceSent": 0.02, "age": -0.01, "withBundleId": 0.25, "withGeo": -0.3},
        categories={
            "gender": {"F": 0.2, "O": 0.1, "P": -0.1, "NA": 0.0},
            "conType": {"1-URGENT": 0.3, "2-HIGH": -0.2, "(null)": 0.15, "NA": 0.0},
        },
    )
