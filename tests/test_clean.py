import pytest

from conftest import race_row, race_table
from paceline.operators import clean
from paceline.schema import RACE


def test_removed_distances(spark):
    texts = ["50mi", "50km", "50K", "6h", "2d", "30min", "100km/2Etappen", "5x10km", "300km", None, "0km"]
    rows = [race_row(i, 2020, "Run", t, "5:00:00 h") for i, t in enumerate(texts)]
    got = clean.clean_races(race_table(spark, rows)).orderBy(RACE.entity).collect()
    assert [r[RACE.distance] for r in got] == pytest.approx([80.467, 50.0, 50.0])


def test_named_events_go_in_any_case(spark):
    rows = [
        race_row(i, 2020, e, "50km", "5:00:00")
        for i, e in enumerate(["STOCKHOLM Fotrally (SWE)", "x Maratonmarschen Stockholm (SWE) y", "Stockholm Fotrally"])
    ]
    assert [r[RACE.entity] for r in clean.clean_races(race_table(spark, rows)).collect()] == [2]


def test_required_columns(spark):
    gaps = ["Athlete gender", "Athlete year of birth", "Athlete age category", "Athlete performance"]
    rows = [race_row(i, 2020, "Run", "50km", "5:00:00", **{c: None}) for i, c in enumerate(gaps)]
    rows.append(race_row(9, 2020, "Run", "50km", "123.4 km"))
    rows.append(race_row(None, 2020, "Run", "50km", "5:00:00"))
    assert [r[RACE.entity] for r in clean.clean_races(race_table(spark, rows)).collect()] == [None]


def test_corrections_replace_number_and_text(spark):
    rows = [race_row(1, 2020, "Ultraroztocze 120km (POL)", "12km", "10:00:00")]
    got = clean.clean_races(race_table(spark, rows), corrections=clean.DISTANCE_CORRECTIONS).first()
    assert (got[RACE.distance], got[RACE.distance_text], got[RACE.pace]) == (120.0, "120km", 5.0)


@pytest.mark.parametrize("limit", [100, 1])
def test_single_valued_entities(spark, limit):
    """The window form and the anti-join form agree, nulls included."""
    rows = [(1, "M"), (1, "F"), (2, "M"), (2, "M"), (None, "F"), (None, "F"), (3, None), (4, None), (4, "M")]
    df = spark.createDataFrame(rows, "id int, g string")
    got = clean.single_valued_entities(df, "id", "g", max_group_rows=limit).select("id").collect()
    assert sorted((r.id for r in got), key=str) == [2, 2, 3, None, None]


def test_audits(spark):
    rows = [race_row(1, 2020, "Run 2020", None, "x"), race_row(2, 2020, "Run 2020", None, "y")]
    df = race_table(spark, rows)
    assert [tuple(r) for r in clean.missing_distance_events(df).collect()] == [("Run 2020", 2020)]
    assert [r[0] for r in clean.names_with_digits(df, RACE.event).collect()] == ["Run 2020"]
    listed = spark.createDataFrame([(1,)], "`Athlete ID` long")
    assert [r[RACE.entity] for r in clean.entities_not_in(df, RACE.entity, listed).collect()] == [2]


def test_distinct_reduction(spark):
    df = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b", "b"), ("b", "b")], "x string, y string")
    assert tuple(clean.distinct_reduction(df, "x", "y").first()) == pytest.approx((3, 2, 100 / 3))


def test_long_list_of_names(spark):
    names = [(f"Race  {i} (A|B)",) for i in range(3000)] + [(None,), ("race 5 (a|b) ",)]
    rows = [(1, "RACE 7 (a|b)"), (2, " race 2999  (A|B)"), (3, "Race 3000 (A|B)"), (4, None), (5, "other"), (6, "a Race 7 (A|B)")]
    df = spark.createDataFrame(rows, "_listed int, name string")
    kept = clean.drop_listed_events(df, "name", spark.createDataFrame(names, "event string"), "event")
    assert kept.columns == df.columns
    assert sorted(r["_listed"] for r in kept.collect()) == [3, 5, 6]
    none = spark.createDataFrame([], "event string")
    assert clean.drop_listed_events(df, "name", none, "event").count() == 5
