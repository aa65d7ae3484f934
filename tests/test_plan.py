import pytest
from pyspark.sql import functions as F

import voxloom as vx
from voxloom.plans.estimate import even_budget


@pytest.fixture(scope="module")
def twi(catalog):
    return vx.pick_languages(catalog, "twi_twi")


def test_budget_plan(twi):
    mean = 50.32 * 3600 / 17140
    row = vx.plan_samples(twi, max_seconds=1800.0).first()
    assert row.planned == round(1800 / mean) and row.available == 15794
    assert row.planned_seconds == pytest.approx(row.planned * mean, abs=0.06)
    assert row.planned_hours == 0.5 and row.country_name == "Ghana" and row.split == "train"
    assert vx.plan_samples(twi, per_language=50, max_seconds=1800.0).first().planned == 50


def test_plan_is_bounded_by_what_there_is(catalog):
    few = vx.pick_languages(catalog, "ewi_few")
    assert vx.plan_samples(few, per_language=1000).first().planned == 20
    assert vx.plan_samples(few, per_language=5).first().planned == 5
    assert vx.plan_samples(few).first().planned == 20
    assert vx.plan_samples(few, split="test").first().planned == 0


def test_zero_budget_still_plans_one_clip(twi):
    row = vx.plan_samples(twi, max_seconds=0.0).first()
    assert row.planned == 1


def test_window_moves_the_assumed_length(twi):
    assert vx.plan_samples(twi, max_seconds=1800.0, max_clip_seconds=5.0).first().planned == 360
    assert vx.plan_samples(twi, max_seconds=1800.0, min_clip_seconds=20.0).first().planned == 90
    # The upper bound wins over a lower bound above it.
    assert vx.plan_samples(twi, max_seconds=1800.0, min_clip_seconds=20.0, max_clip_seconds=10.0).first().planned == 180


def test_language_without_clips(catalog):
    row = vx.plan_samples(vx.pick_languages(catalog, "zul_non"), max_seconds=100.0).first()
    assert (row.planned, row.planned_seconds, row.planned_hours) == (0, 0.0, 0.0)


def test_negative_caps_are_refused(twi):
    with pytest.raises(ValueError):
        vx.plan_samples(twi, per_language=-1)


def test_budget_per_language():
    assert even_budget(24.0, None, 8) == 3.0 * 3600
    assert even_budget(24.0, 1.0, 8) == 3.0 * 3600
    assert even_budget(None, 0.5, 8) == 1800.0
    assert even_budget(0.0, 0.0, 8) is None
    assert even_budget(1.0, None, 0) == 3600.0


def test_totals_and_view(catalog):
    plan = vx.plan_samples(vx.pick_languages(catalog, "twi_twi,bel_two,aba_one"), per_language=100)
    totals = vx.plan_totals(plan).first()
    assert (totals.languages, totals.countries, totals.planned_clips) == (3, 2, 300)
    assert totals.planned_hours == pytest.approx(sum(r.planned_hours for r in plan.collect()))
    assert vx.plan_view(plan).columns == [
        "language", "country", "iso", "hours", "clips", "in_split", "to_pull", "est_hours", "subset"
    ]


def test_brief_view(catalog):
    plan = vx.plan_samples(vx.pick_languages(catalog, "twi_twi"), per_language=5)
    assert vx.plan_view(plan, brief=True).first().asDict() == {
        "language": "Twi", "country": "Ghana", "iso": "twi", "hours": 50.32, "in_split": 15794, "to_pull": 5, "est_h": 0.01
    }


def test_shortfall(catalog):
    plan = vx.plan_samples(vx.pick_languages(catalog, "ewi_few,twi_twi"), max_seconds=36000.0)
    row = vx.shortfall_summary(plan, 20.0, 36000.0).first()
    assert row.short and row.limiting == 1 and row.limited_by == "Ewi" and row.planned_hours == 10.07
    assert not vx.shortfall_summary(plan, 10.0, 36000.0).first().short


def test_shortfall_names_six_in_selection_order(catalog):
    names = ["ewi_few"] * 3 + ["cor_tie", "dun_tie", "aba_one", "bel_two"]
    plan = vx.plan_samples(vx.pick_languages(catalog, names), max_seconds=1e6)
    row = vx.shortfall_summary(plan, 2000.0, 1e6).first()
    assert row.limiting == 7 and row.limited_by == "Ewi, Ewi, Ewi, Coro, Duna, Abba…"
    assert vx.shortfall_summary(plan.where(F.lit(False)), 1.0, 1e6).first().limited_by == ""
    every = vx.shortfall(plan, 1e6).orderBy("position").collect()
    assert [r.language for r in every] == ["Ewi", "Ewi", "Ewi", "Coro", "Duna", "Abba", "Belo"]
    assert all(r.planned_seconds + r.missing_seconds == 1e6 for r in every)
