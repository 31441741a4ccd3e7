"""The three whole jobs on small inputs."""

from pyspark.sql import functions as F

from stepframe import plans
from stepframe import sources as S
from stepframe.session import scratch_path


def test_airlines(spark, as_rows):
    def line(name, speed, cost):
        cells = {1: name.ljust(20), 30: str(speed).rjust(7), 54: str(cost).rjust(7)}
        text = ""
        for start in sorted(cells):
            text = text.ljust(start - 1) + cells[start]
        return text.ljust(108)

    data = [("Pan Am", 500, 40), ("Pacific", 600, 50), ("Delta", 600, 120), ("Swiss", 450, ""), ("KLM", 300, 250)]
    path = scratch_path(spark, "airlines-test")
    spark.createDataFrame([(line(*d),) for d in data], "value string").coalesce(1).write.text(path)
    rows = plans.airlines_read(spark, path)
    assert rows.schema["Revenue"].metadata == {"format": "dollar9.2"} and len(rows.columns) == 12
    r = plans.airlines_job(rows)
    assert {x.Airline: x.RATING for x in r.airlines.collect()} == {
        "Pan Am": 5, "Pacific": None, "Delta": 3, "Swiss": 5, "KLM": 1}
    assert as_rows(r.airlines_p.select("Airline")) == [("Pacific",), ("Pan Am",)]
    assert as_rows(r.chart_hbar) == [(None, 0, 4, (40 + 120 + 250) / 3), (1, 1, 1, 250.0), (3, 1, 1, 120.0),
                                     (5, 1, 2, 40.0)]
    assert as_rows(r.chart_vbar) == [(None, 1, None), (1, 1, 25.0), (3, 1, 25.0), (5, 2, 50.0)]
    assert as_rows(r.fastplane) == [("Delta", 600.0), ("Pacific", 600.0)]


def test_cars(spark):
    schema = "make string, model string, origin string, type string, msrp double, seq int"
    usa = spark.createDataFrame([("Ford", "X", "USA", "SUV", 20.0, 1)], schema)
    europe = spark.createDataFrame([(" BMW", "X5 ", "Europe", "SUV", 50.0, 2), ("BMW", "X5", "Europe", "SUV", 55.0, 3),
                                    ("VW", "T", "Europe", "SUV", 50.0, 4), ("VW", "P", "Europe", "Sedan", 9.0, 5)], schema)
    mileage = spark.createDataFrame([("BMW ", "X5", 21.0, 1), ("VW", "T", 30.0, 2), ("Fiat", "Q", 40.0, 3)],
                                    "make string, model string, mpg_highway double, seq2 int")
    got = plans.cars_job([usa, europe], mileage, ["seq"], ["seq2"])
    assert [(r.make, r.model, r.msrp, r.mpg_highway) for r in got.collect()] == [
        ("VW", "T", 50.0, 30.0), ("BMW", "X5", 50.0, 21.0), ("BMW", "X5", 55.0, 21.0)]


def test_age_dimension(spark):
    ages = S.generate_series(spark, 0, 150, "NM_AGE")
    classes = spark.createDataFrame([(0.0, 24.0), (25.0, 64.0), (65.0, 150.0)], "NM_AGE_MIN double, NM_AGE_MAX double")
    target = spark.createDataFrame([(17, 30), (99, 31)], "ID_AGE bigint, NM_AGE bigint")
    path = scratch_path(spark, "age-test")
    got = plans.age_dimension(ages, classes, target, path)
    assert got.schema == plans.AGE_DIMENSION and got.count() == 153
    by_age = {r.NM_AGE: r for r in got.where("NM_AGE is not null").collect()}
    assert (by_age[30].ID_AGE, by_age[31].ID_AGE) == (17, 99)
    new = sorted((r.ID_AGE, a) for a, r in by_age.items() if a not in (30, 31))
    assert [i for i, _ in new] == list(range(100, 249)) and [a for _, a in new] == sorted(a for _, a in new)
    assert by_age[3].TX_AGE == "3" and by_age[3].TX_AGE_CLASS == "0-24"
    assert by_age[25].TX_AGE_CLASS_DESCR_NL == "25 t.e.m. 64 jaar"
    assert by_age[25].TX_AGE_CLASS_DESCR_FR == "25 à 64 ans"
    assert by_age[150].TX_AGE_CLASS == "65+" and by_age[150].TX_AGE_CLASS_DESCR_FR == "65 ans ou plus"
    special = {r.ID_AGE: r for r in got.where("ID_AGE < 0").collect()}
    assert special[-1].TX_AGE_NL == "Niet beschikbaar" and special[-2].TX_AGE_FR == "Inconnu"
    assert special[-1].NM_AGE is None
    out = scratch_path(spark, "age-export-test")
    S.labelled_export(got, out, drop=["TX_AGE", "TX_AGE_CLASS"])
    assert S.sheet_import(spark, out).columns == ["Age dimension id", "Age", "Leeftijd", "Âge", "Leeftijdsklasse",
                                                  "Classe d'âge"]


def test_age_class_without_upper_bound_counts_as_closed(spark):
    ages = spark.createDataFrame([(None,), (3,)], "NM_AGE bigint")
    classes = spark.createDataFrame([(None, 10.0)], "NM_AGE_MIN double, NM_AGE_MAX double")
    got = plans.with_age_classes(ages, classes)
    assert {r.NM_AGE: r.TX_AGE_CLASS for r in got.collect()} == {None: ".-10", 3: ".-10"}
    assert got.where(F.col("NM_AGE").isNull()).first().TX_AGE == "."
