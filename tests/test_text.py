import pytest
from pyspark.sql import functions as F

from paceline.functions import text


def values(spark, function, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r[1] for r in df.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_event_names(spark):
    cases = {
        "10th Trail Run (2018) (GER)": "trail run",
        "9ª Ultra São 2019": "ultra s o",
        "A  –  B C!": "a b c",
        "Run 12345": "run 12345",
        "100km Lauf 1999": "100km lauf",
        "": "",
        None: None,
    }
    assert values(spark, text.clean_event_name, list(cases)) == list(cases.values())


def test_noisy_event_names(spark):
    cases = {
        "100km Lauf Etappe 3 (GER) 2018": "lauf",
        "6 hour Run": "run",
        "24 stunden kidsrun Bern": "bern",
        "12 órás futás": "fut s",
        "50 kmh": "kmh",
        "Trail Race Winter Challenge X": "x",
        None: None,
    }
    assert values(spark, text.clean_event_name_noise, list(cases)) == list(cases.values())


def test_cleaner_hook(spark):
    df = spark.createDataFrame([("Abc",)], "`Event name` string")
    assert text.with_clean_name(df, cleaner=F.upper).first()["Event_name_clean"] == "ABC"


@pytest.mark.parametrize("strict", [False, True])
def test_durations(spark, strict):
    cases = {
        "4:30:15 h": (16215, 16215),
        "2d 06:45:20": (197120, 197120),
        "2d 6:45:20": (197120, None),
        "1d2:03:04": (7384, None),
        "about 1:02:03": (3723, None),
        "123.4 km": (None, None),
        "99999999999:00:00": (None, None),
        "": (None, None),
        None: (None, None),
    }
    function = text.duration_seconds_strict if strict else text.duration_seconds
    assert values(spark, function, list(cases)) == [c[strict] for c in cases.values()]


def test_duration_groups(spark):
    df = spark.createDataFrame([("2d 6:45:20",), ("1:2:3",), ("x",)], "v string")
    rows = [tuple(r[0]) for r in df.select(text.groups(F.col("v"), text.DURATION, 4)).collect()]
    assert rows == [("2", "6", "45", "20"), (None, "1", "2", "3"), (None, None, None, None)]


def test_distances(spark):
    cases = {
        "50mi": 50 * 1.60934,
        "50km": 50.0,
        "50K": 50.0,
        "42.195km": 42.195,
        "100 Miles": 100 * 1.60934,
        "none": None,
        None: None,
    }
    assert values(spark, text.distance_km, list(cases)) == pytest.approx(list(cases.values()))


def test_legacy_units_count_km_as_miles(spark):
    got = values(spark, lambda c: text.distance_km(c, legacy_units=True), ["45km", "45K"])
    assert got == pytest.approx([45 * 1.60934, 45.0])


def test_null_tokens(spark):
    got = values(spark, lambda c: text.null_if_token(c, ["", "NA"]), ["", "NA", "na", None])
    assert got == [None, None, "na", None]
