import pytest
from pyspark.sql import SparkSession

from paceline.schema import RAW_SCHEMA


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("paceline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def race_row(athlete, year, event, distance, performance, **other):
    row = {
        "Year of event": year,
        "Event dates": f"01.01.{year}",
        "Event name": event,
        "Event distance/length": distance,
        "Event number of finishers": 100,
        "Athlete performance": performance,
        "Athlete club": None,
        "Athlete country": None,
        "Athlete year of birth": 1985.0,
        "Athlete gender": "M",
        "Athlete age category": "M35",
        "Athlete average speed": None,
        "Athlete ID": athlete,
    }
    row.update(other)
    return row


def race_table(spark, rows):
    names = [f.name for f in RAW_SCHEMA.fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RAW_SCHEMA)


@pytest.fixture(scope="session")
def races(spark):
    """Eight results of three athletes."""

    def person(athlete):
        birth, gender = {1: (1985.0, "M"), 2: (1990.0, "F"), 3: (1980.0, "M")}[athlete]
        return {"Athlete year of birth": birth, "Athlete gender": gender}

    rows = [
        race_row(1, 2020, "Race A", "50km", "3:30:00", **person(1)),
        race_row(1, 2021, "Race A", "50km", "3:15:00", **person(1)),
        race_row(1, 2022, "Western States", "100km", "8:00:00", **person(1)),
        race_row(2, 2020, "Race B", "80km", "4:00:00", **person(2)),
        race_row(2, 2021, "Race B", "80km", "3:45:00", **person(2)),
        race_row(2, 2022, "Race C", "60km", "3:20:00", **person(2)),
        race_row(3, 2021, "Race D", "70km", "3:50:00", **person(3)),
        race_row(3, 2022, "Western States", "100km", "7:45:00", **person(3)),
    ]
    return race_table(spark, rows)
