"""Queries on verdicts compute what they read, by compiled code; what is read stays the same."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import by_id
from lumenscan.functions import text as X
from lumenscan.operators import verdict as V
from lumenscan.plans import driver_rule_queries  # noqa: F401  registers the queries
from lumenscan.plans.driver_queries import QUERIES
from lumenscan.rulebook import PROFILE_COLLAGEN
from test_rules import verdict_rows
from test_sign_steps import table  # noqa: F401  a fixture


def optimized(spark, path, name):
    return QUERIES[name][0](spark, path)._jdf.queryExecution().optimizedPlan().toString()


# ------------------------------------------------------------------------------------------ F7
def test_warnings_of_a_card_are_compiled(spark, table):  # noqa: F811
    assert not re.search(r"lambdafunction\(array_contains\(", optimized(spark, table[0], "card_labels"))     # interpreted for every warning


def test_place_notes_by_warnings(spark):
    notes = lambda *keys: [(k, {}, None) for k in keys]
    rows = [(1, (notes("a", "w2", "b", "w1"), ["a", "w2", "w1"], [])), (2, (notes(None, "b"), ["b"], [])), (3, (None, None, None)), (4, None)]
    d = spark.createDataFrame(rows, f"k int, verdict struct<notes_all:{V.NOTES},notes_shown:array<string>,flags:array<{V.FLAG}>>")
    for nt, warned in (({"warnings": ["w1", "w2", "w3"]}, ["w1", "w2"]), ({"warnings": ["w2"]}, ["w2"]), ({"warnings": []}, []), ({}, [])):
        got = {r["k"]: r["placed"] for r in V.place_notes(d, nt).collect()}
        assert got[1].warnings == warned and got[1].headline == [k for k in ("a", "w2", "w1") if k not in warned]
        assert [n.key for n in got[1].details] == ["b"]
        assert [got[k].warnings for k in (2, 3, 4)] == [[], [], []] and got[2].headline == ["b"] and got[3].headline is None


# ------------------------------------------------------------------------------------------ F8 to F10
READ = ["collagen_verdict", "readable_words", "explanation"]


@pytest.mark.parametrize("name", READ)
def test_unread_notes_are_not_computed(spark, table, name):  # noqa: F811
    plan = optimized(spark, table[0], name)
    assert "possible_thin_coating" not in plan and "models_disagree" not in plan


def test_shown_notes_are_not_computed_for_labels(spark, table):  # noqa: F811
    assert optimized(spark, table[0], "card_labels").count("filter(") <= 3      # those of the soft tier


def test_a_verdict_without_a_reading(spark):
    panel = {"readers": {"ch": "chr"}, "ch_above_nh": {"cons3_bin_edges": [1.0], "possible_above": [2.0, 1.0], "strong_above": [4.0, 3.0]}}
    prof = {**PROFILE_COLLAGEN, "models": [{"key": "chr", "model_id": "ch", "role": "reader"}], "notes": {**PROFILE_COLLAGEN["notes"], "panel": panel}}
    cases = {"none": dict(m=None, comps=None, fired=("wax", "burnt")), "nan": dict(m=float("nan"), level="none"), "read": dict(m=2.0)}
    d = verdict_rows(spark, cases).withColumn("models", F.expr("map('ch', named_struct('value', 4.5D))"))
    for p, has_panel in ((prof, True), (PROFILE_COLLAGEN, False)):
        got = by_id(V.collagen_verdict(d, p), "verdict")
        for k in ("none", "nan"):
            v = got[k]
            assert (v.verdict, v.rule_step, v.model_verdict, v.notes_shown, v.panel) == ("Can't tell", "no_model_reading", None, [], None)
            assert [(n.key, n.params, n.provisional) for n in v.notes_all] == [("no_model_reading", {}, None)]
        assert [(f.key, f.signs) for f in got["none"].flags] == [("flag_contaminant", ["wax"]), ("flag_burnt", ["burnt"])] and got["nan"].flags == []
        assert got["read"].model_verdict == "Borderline" and (got["read"].panel is not None) == has_panel


def test_labels_of_cards_with_and_without_flags(spark):
    d = verdict_rows(spark, {"no": {}, "two": dict(fired=("wax", "burnt"), uncal=True)})
    got = by_id(V.card_items(V.place_notes(V.collagen_verdict(d), PROFILE_COLLAGEN["notes"]), X.NOTE_WORDS, X.FLAG_WORDS), "card")
    assert got["no"].alerts == [] and got["two"].alerts == ["Lipid sign (provisional)", "Heat sign (provisional)"]
