import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from kinshelf.schemas import CATALOGUE  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("kinshelf-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="kinshelf-tests-"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_books(spark, rows):
    """rows: (id, title, description, authors, categories)"""
    return spark.createDataFrame(
        [(i, t, None, None, d, None, None, a, c) for i, t, d, a, c in rows], CATALOGUE)


@pytest.fixture(scope="session")
def shelf(spark):
    return make_books(spark, [
        (1, "The Harbour Lamp", "A keeper guards a story of storms and lost ships on a northern coast", "Ada Fenn", "Novel|Sea"),
        (2, "Bread for Winter", "Recipes and stories of a village bakery through one cold year", "Tom Varga", "Cooking|Memoir"),
        (3, "Orchards and Bees", "A garden novel about patience and marriage in a small valley", "Ines Roth", "Novel|Garden"),
        (4, "The Clock under the Stairs", "A growing-up story in a house of broken clocks", "Lee Okada", "Novel|Childhood"),
        (5, "2077", "A science novel of machines that govern a city", "Mira Sol", "Science|Future"),
    ])
