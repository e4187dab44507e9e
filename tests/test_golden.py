"""Issues and scores of the hand-computed tables."""

import pytest
import tables


@pytest.mark.parametrize("name", list(tables.SCORES))
def test_issues_and_score(check, name):
    a = check(getattr(tables, name))
    found = [
        (r["type"], r["column"], r["affected_rows"], r["percentage"], r["severity"])
        for r in a.issues().orderBy("ordinal").collect()
    ]
    assert found == tables.ISSUES[name]
    row = a.score().first()
    dims = tuple(row[d] for d in ("completeness", "validity", "uniqueness", "consistency"))
    assert (*dims, row["overall"]) == tables.SCORES[name]
    assert len(row["explanation"]) == 5


def test_fences_are_shown_half_even(check):
    shown = {
        r["column"]: r["description"]
        for r in check(tables.MESSY).issues().where("type = 'outliers'").collect()
    }
    assert "[1.12, 6.12]" in shown["age"]
    assert "[33.31, 44.81]" in shown["deposit_total"]
    assert "[-0.94, 9.56]" in shown["damage_rate"]


def test_catastrophic_scores_stay_in_bounds(check):
    rows = "9,-50,400,nobody,Q,\n" * 4
    row = check("id,age,percent,email,fixed,blank\n" + rows).score().first()
    for d in ("overall", "completeness", "validity", "uniqueness", "consistency"):
        assert 0 <= row[d] <= 100


def test_normalized_duplicates(check):
    found = check("river,no\nelbe,1\nELBE ,1\noder,2\nmain,3\n").issues()
    row = found.where("type = 'normalized_duplicate_rows'").first()
    assert row["affected_rows"] == 2 and row["severity"] == "medium"


def test_text_anomalies(check):
    rows = [
        "The kettle sings on the stove.", ".", "zzzzz", "more more more more", "  wide  ",
        "Rain falls on the tin roof.",
    ]
    found = check("description\n" + "\n".join(rows) + "\n").issues()
    counts = {r["type"]: r["affected_rows"] for r in found.collect()}
    assert counts["near_empty_text"] == 1
    assert counts["repeated_text_anomaly"] == 2
    assert counts["whitespace_formatting_anomaly"] == 1
