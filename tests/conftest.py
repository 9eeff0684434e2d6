import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def study(spark):
    """The five-page study, analysed and stored in memory."""
    from tests import forms_fixture

    return forms_fixture.analysed(spark, "study1", forms_fixture.STUDY_1)


@pytest.fixture(scope="session")
def second(spark):
    from tests import forms_fixture

    return forms_fixture.analysed(spark, "study2", forms_fixture.STUDY_2)


@pytest.fixture(scope="session")
def blank(spark):
    from tests import forms_fixture

    return forms_fixture.analysed(spark, "blank", forms_fixture.without_markup(forms_fixture.STUDY_1))
