"""Documented cases of the name functions."""

import pytest
from pyspark.sql import functions as F

from stopgrid.functions import text as T
from stopgrid.functions.similarity import candidates, word_similarity


@pytest.fixture(scope="module")
def values(spark):
    def run(f, rows, schema="a string"):
        df = spark.createDataFrame(rows, schema)
        return [r[0] for r in df.select(f(*(F.col(c) for c in df.columns))).collect()]

    return run


def test_folds(values):
    assert values(T.search_fold, [("St. Gallen",), ("Lyon-Part-Dieu",), ("Cœur d'Orly",), (None,), ("Łódź",)]) == ["st gallen", "lyon part dieu", "coeur dorly", "", "lodz"]
    assert values(T.elision_fold, [("Cœur d'Orly",)]) == ["coeur d orly"]
    assert values(T.fold, [("İzmir ı",), ("é",), ("한가が",)]) == ["izmir i", "e", "한가か"]


def test_poles_and_quays(values):
    schema = "a string, b string, c boolean"
    rows = [("Park Bronowice 02", None, True), ("Szkoła nr 12", None, True), ("Skrzyżowanie 1532", "1532", True), ("Opoczyńska 145", "7", True), ("Park 02", None, False)]
    assert values(T.without_pole, rows, schema) == ["Park Bronowice", "Szkoła nr 12", "Skrzyżowanie", "Opoczyńska 145", "Park 02"]
    assert values(T.without_quay, [("Centre (E)",), ("Centre (Quai 3)",), ("Centre (Nord)",)]) == ["Centre", "Centre", "Centre (Nord)"]
    assert values(T.without_line, [("Étoile (Métro 1)",), ("Étoile (MÉTRO 6) ",), ("Étoile (metropole)",)]) == ["Étoile", "Étoile", "Étoile (metropole)"]
    assert values(T.quay_code, [("B12",), ("Voie n° 3",), ("Gleis 4",), ("345",)]) == ["B12", "3", None, "345"]
    assert values(T.town_stripped, [("Royan - Gare",), ("A - B - C",)]) == ["Gare", "B - C"]


def test_runs_and_codes(values):
    assert values(lambda c: F.array_sort(T.name_runs(c)), [("泉州东站",), ("a b",), ("",)]) == [["泉州", "泉州东", "泉州东站"], ["a", "a b", "b"], []]
    assert values(T.is_code_key, [("railway:ref:DB",), ("railway:ref:fr",), ("railway:ref:parent",), ("uic_ref",), ("ref",)]) == [True, False, False, True, False]
    assert values(T.track_ref, [("Voie 1Est",), ("Gleis 7",), ("3 bis",)]) == ["1 Est", "7", "3 bis"]


def test_word_similarity(spark):
    assert word_similarity("word", "two words") == pytest.approx(0.8)
    assert word_similarity("abc", "xyz") == 0.0 and word_similarity(None, "x") is None
    names = ["gare de lyon", "garde", "lyon", "paris nord", "gare montparnasse"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for q in ("gare", "lyn", "montparnase"):
        kept = {r[0] for r in candidates(df, "n", q, 0.6).collect()}
        assert {n for n in names if word_similarity(q, n) >= 0.6} <= kept
