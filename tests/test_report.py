"""The report over the fixture tables: shape, known answers, evidence, limitations."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from veritable.operators import rows
from veritable.plans import report as report_module
from veritable.plans.lens import MODES
from veritable.plans.ranking import follow_ups, top_findings
from veritable.plans.report import build_report
from veritable.sources.delimited import scan_text
from veritable.sources.row_ids import write_with_row_ids
from veritable import Dataset, scratch_path

FIELDS = {
    "id", "title", "category", "explanation", "why_it_matters", "confidence", "trust_score", "evidence_rows",
    "evidence_columns", "supporting_metrics", "what_to_check_next", "is_limitation",
}
MONDAY = dt.date(2026, 1, 5)


def weeks(counts):
    """Rows (date, product) from a count per day index and product."""
    return [(MONDAY + dt.timedelta(days=d), p) for d, p, n in counts for _ in range(n)]


def leader_weekday():
    counts = []
    for d in range(84):
        counts += [(d, "Alpha", (2 if d < 42 else 6) + (12 if d % 7 == 2 else 0)), (d, "Beta", 2)]
    return weeks(counts)


def synthetic():
    return [(f"2024-01-{i:02d}", i, 1000.0 if i == 20 else 2.0 * i, "A" if i <= 35 else "B") for i in range(1, 41)]


def sales(n=30):
    return [
        (dt.date(2025, 1, 1) + dt.timedelta(days=i), "XYZ"[i % 3], "NSEW"[i % 4], i % 9, 10.5 * (i % 11) + i % 4)
        for i in range(n)
    ]


rng = random.Random(11)
FIXTURES = {
    "synthetic": (synthetic(), "date string, x int, y double, grp string"),
    "clean_linear": ([(i + 0.5, 2 * i + 1.0, "A" if i < 30 else "B") for i in range(40)], "x double, y double, grp string"),
    "leader_weekday": (leader_weekday(), "date date, product string"),
    "flat_week": (weeks([(d, "Only", 20) for d in range(7)]), "date date, product string"),
    "multi_outlier": ([(i, 100 + i % 5) for i in range(60)] + [(60, 9000), (61, 9500), (62, 10000)], "id int, v int"),
    "big_lead": (weeks([c for d in range(56) for c in ((d, "Alpha", 3 if d < 28 else 15), (d, "Beta", 1))]), "date date, product string"),
    "renamed_date_trend": ([(MONDAY + dt.timedelta(days=d), d) for d in range(60) for _ in range(int(2 + 0.5 * d))], "day date, v int"),
    "random_small": ([(rng.random(), rng.random()) for _ in range(15)], "a double, b double"),
    "tiny_float": ([(0.5, 1.5), (1.5, 2.5), (2.5, 1.0)], "a double, b double"),
    "sales": (sales(), "order_date date, product string, region string, units int, revenue double"),
    "no_date": ([r[1:] for r in sales()], "product string, region string, units int, revenue double"),
    "only_text": ([("abc"[i % 3], "NS"[i % 2], "ok") for i in range(30)], "product string, region string, status string"),
    "tiny_int": ([(1, 2), (3, 4), (5, 6)], "a int, b int"),
    "single_category": ([("same", f"u{i}", i * 1.5) for i in range(40)], "category string, uid string, amount double"),
    "messy": ([(f"n{i}", "x", None, i) for i in range(25)], "name string, name_1 string, empty string, val int"),
    "empty": ([], "a int, d date, s string"),
    "all_null": ([(None, None, None)] * 40, "a int, d date, s string"),
    "one_row": ([(1, MONDAY, "x")], "a int, d date, s string"),
}


@pytest.fixture(scope="module")
def reports(make):
    done = {}

    def get(name):
        if name not in done:
            ds = make(*FIXTURES[name], name)
            done[name] = (ds, build_report(ds).as_dict())
        return done[name]

    return get


def card(report, id):
    return next((c for c in report["insights"] if c["id"] == id), None)


@pytest.mark.parametrize("name", FIXTURES)
def test_every_table_gets_a_whole_report(reports, name):
    ds, report = reports(name)
    assert report["mode"] == "analyst" and report["summary"]["rows"] == ds.count_rows()
    assert report["follow_up_questions"] and len(report["key_takeaways"]) <= 3
    json.dumps(report, default=str)
    for c in report["insights"]:
        assert FIELDS <= set(c)
        assert 0 <= c["confidence"] <= 1 and 0 <= c["trust_score"] <= 100
        assert c["title"] and c["explanation"] and c["why_it_matters"] and c["what_to_check_next"]
        assert all(isinstance(r, int) for r in c["evidence_rows"]) and len(c["evidence_rows"]) <= 25
        assert c["is_limitation"] or c["supporting_metrics"]
        assert not c["id"].endswith("_unavailable"), c


def test_outlier_rows_are_outside_the_fence(reports):
    ds, report = reports("synthetic")
    found = card(report, "anomaly_y")["supporting_metrics"]
    cited = rows.rows_by_id(ds, card(report, "anomaly_y")["evidence_rows"]).collect()
    assert found["outlier_count"] == 1 and [r.y for r in cited] == [1000.0]
    assert all(r.y < found["lower_fence"] or r.y > found["upper_fence"] for r in cited)
    assert card(report, "trend")["is_limitation"]  # the dates are text


def test_dominant_label_and_its_rows(reports):
    ds, report = reports("synthetic")
    found = card(report, "concentration_grp")
    assert found["supporting_metrics"]["dominant_value"] == "A" and found["supporting_metrics"]["share_pct"] == 87.5
    assert {r.grp for r in rows.rows_by_id(ds, found["evidence_rows"]).collect()} == {"A"}


def test_perfect_line(reports):
    found = card(reports("clean_linear")[1], "correlation_top")["supporting_metrics"]
    assert found["pearson_r"] > 0.99 and found["n"] == 40 and found["strength"] == "strong"


def test_weekday_month_and_leader(reports):
    report = reports("leader_weekday")[1]
    pattern = card(report, "time_pattern")["supporting_metrics"]
    assert pattern["busiest_weekday"] == "Wednesday" and pattern["peak_month"]
    assert pattern["leading_category"] == "Alpha" and pattern["category_peak_weekday"] == "Wednesday"
    moved = card(report, "what_changed")["supporting_metrics"]
    assert moved["top_movers"][0]["label"] == "Alpha" and moved["second_label"] == "Beta"
    assert moved["lead_pct"] == round((moved["leader_total"] - moved["second_total"]) / moved["second_total"] * 100, 2)


def test_flat_week_has_no_pattern(reports):
    report = reports("flat_week")[1]
    assert card(report, "time_pattern") is None
    single = card(report, "single_value_product")
    assert single["is_limitation"] and single["trust_score"] == 15 and single["confidence"] == 0
    assert "dimension" not in card(report, "what_changed")["supporting_metrics"]


def test_several_outliers(reports):
    found = card(reports("multi_outlier")[1], "anomaly_v")
    assert found["supporting_metrics"]["outlier_count"] == 3 and found["title"] == "3 values beyond the fences of v"


def test_large_lead_reads_as_a_multiple(reports):
    found = card(reports("big_lead")[1], "what_changed")
    assert found["supporting_metrics"]["lead_pct"] > 200 and "×" in found["explanation"]


def test_trend_of_a_renamed_date(reports):
    found = card(reports("renamed_date_trend")[1], "trend")
    assert found["supporting_metrics"]["direction"] == "increasing" and found["confidence"] > 0.9
    assert found["supporting_metrics"]["date_column"] == "day"


def test_random_data_has_no_headline(reports):
    report = reports("random_small")[1]
    tops = [c for c in report["insights"] if c["category"] == "top_insights"]
    assert [c["id"] for c in tops] == ["top_insights_none"] and tops[0]["is_limitation"]
    assert report["key_takeaways"] == []


def test_small_samples_are_marked(reports):
    report = reports("tiny_float")[1]
    assert report["data_quality"]["small_sample_warning"]["triggered"]
    assert card(report, "anomalies")["is_limitation"] and card(report, "correlation")["is_limitation"]


def test_dates_have_a_midpoint(reports):
    found = card(reports("sales")[1], "what_changed")
    assert found["supporting_metrics"]["midpoint"] == "2025-01-15T12:00:00"


def test_identifiers_are_not_measured(reports):
    assert card(reports("tiny_int")[1], "correlation")["is_limitation"]
    assert card(reports("only_text")[1], "anomalies") is None


def test_empty_column_is_flagged(reports):
    ds, report = reports("messy")
    found = card(report, "missing_data")
    assert found["supporting_metrics"]["worst_column"] == "empty" and found["supporting_metrics"]["flagged"] == {"empty": 100.0}
    assert found["evidence_rows"] == list(range(25))


def test_no_rows(reports):
    report = reports("empty")[1]
    assert [c["id"] for c in report["insights"]] == ["no_data"]
    assert report["data_quality"]["duplicate_rows"] == 0


def test_filtered_report(make):
    ds = make(*FIXTURES["synthetic"], "synthetic")
    report = build_report(ds, '[{"col": "grp", "op": "eq", "value": "B"}]').as_dict()
    assert report["summary"]["rows"] == 5
    cited = [r for c in report["insights"] for r in c["evidence_rows"]]
    assert cited and min(cited) >= 35


def test_audience_changes_words_only(make):
    ds = make(*FIXTURES["leader_weekday"], "x")
    by_mode = {m: build_report(ds, mode=m).as_dict() for m in ("student", "researcher", "wizard")}
    assert by_mode["wizard"]["mode"] == "analyst"
    numbers = ("id", "title", "confidence", "trust_score", "supporting_metrics", "evidence_rows")
    a, b = (by_mode[m]["insights"] for m in ("student", "researcher"))
    assert [[c[k] for k in numbers] for c in a] == [[c[k] for k in numbers] for c in b]
    assert all(x["why_it_matters"] != y["why_it_matters"] for x, y in zip(a, b))
    assert len({tuple(c["explanation"] for c in r["insights"]) for r in by_mode.values()}) > 1
    assert by_mode["student"]["key_takeaways"] == by_mode["researcher"]["key_takeaways"]
    assert len(MODES) == 5


def test_headlines_are_ranked(reports):
    report = reports("leader_weekday")[1]
    tops = [c for c in report["insights"] if c["category"] == "top_insights"]
    assert 1 <= len(tops) <= 3
    assert [c["supporting_metrics"]["rank"] for c in tops] == list(range(1, len(tops) + 1))
    assert [c["trust_score"] for c in tops] == sorted((c["trust_score"] for c in tops), reverse=True)
    assert all(c["trust_score"] > 20 and card(report, c["supporting_metrics"]["source_insight"]) for c in tops)
    assert [t["rank"] for t in report["key_takeaways"]] == list(range(1, len(tops) + 1))


def test_ranking_covers_several_datasets(spark, make):
    parts = []
    for name in ("leader_weekday", "random_small"):
        facts = report_module.Facts(make(*FIXTURES[name], name))
        parts.append(report_module.section_findings(facts).where("category <> 'executive_summary'"))
    tops = top_findings(parts[0].unionByName(parts[1])).collect()
    assert {(r.dataset_id, r.id) for r in tops if r.id == "top_insights_none"} == {("random_small", "top_insights_none")}
    assert {r.dataset_id for r in tops if r.id.startswith("top_insight_")} == {"leader_weekday"}


def test_a_failing_section_becomes_a_limitation(make, monkeypatch):
    def broken(facts):
        raise RuntimeError("boom")

    changed = [(t, c, broken if c == "correlations" else b) for t, c, b in report_module.SECTIONS]
    monkeypatch.setattr(report_module, "SECTIONS", changed)
    report = build_report(make(*FIXTURES["sales"], "sales")).as_dict()
    failed = card(report, "correlations_unavailable")
    assert failed["is_limitation"] and "RuntimeError" in failed["explanation"]
    assert card(report, "missing_data") and card(report, "what_changed")


def test_follow_ups_are_unique_and_at_most_six(spark, make):
    facts = report_module.Facts(make(*FIXTURES["leader_weekday"], "x"))
    found = report_module.section_findings(facts)
    questions = [r.text for r in follow_ups(found.unionByName(found), 7).collect()]
    assert len(questions) == len(set(questions)) <= 6
    assert any("7 repeated rows" in q for q in questions)


def planted(spark):
    """Orders of a bakery: more each week, most on Fridays, mostly rye; one price is far off."""
    days = spark.range(84).select(F.col("id").alias("n"), F.date_add(F.lit(dt.date(2023, 3, 6)), F.col("id").cast("int")).alias("baked"))
    many = F.floor(4 + F.col("n") / 7) * F.when(F.weekday("baked") == 4, 3).otherwise(1)
    loaves = days.withColumn("k", F.explode(F.sequence(F.lit(1), many.cast("int"))))
    price = F.when((F.col("n") == 50) & (F.col("k") == 1), 9_999.0).otherwise(3 + F.pmod(F.xxhash64("n", "k"), F.lit(200)) / 100)
    sort = F.when(F.pmod(F.xxhash64("k", "n", F.lit(1)), F.lit(10)) < 7, "rye").otherwise("spelt")
    weight = 500 + F.pmod(F.xxhash64("n", "k", F.lit(2)), F.lit(300))
    return loaves.select("baked", sort.alias("sort"), price.alias("price"), weight.alias("weight"))


def test_planted_patterns_are_found(spark):
    table = write_with_row_ids(planted(spark), scratch_path(spark, "planted"))
    report = build_report(Dataset.of(table, name="bakery")).as_dict()
    assert card(report, "trend")["supporting_metrics"]["first_bucket_count"] == 4
    assert card(report, "time_pattern")["supporting_metrics"]["busiest_weekday"] == "Friday"
    assert card(report, "concentration_sort")["supporting_metrics"]["dominant_value"] == "rye"
    assert card(report, "anomaly_price")["supporting_metrics"]["outlier_count"] == 1
    assert card(report, "anomaly_weight") is None
    assert card(report, "correlation_top")["supporting_metrics"]["strength"] == "negligible"


@pytest.mark.parametrize("where, name, part", [
    (report_module.profile, "data_quality", "data_quality"), (report_module.profile, "duplicate_examples", "duplicate_examples"),
    (report_module.profile, "key_numbers", "key_numbers"), (report_module.profile, "date_range", "date_range"),
    (report_module, "follow_ups", "questions"), (report_module, "with_headlines", "headlines"),
    (report_module, "key_takeaways", "takeaways"), (report_module, "section_findings", "findings"),
])
def test_a_failing_part_leaves_the_report(make, monkeypatch, where, name, part):
    def broken(*args, **kwargs):
        raise RuntimeError("planted")

    monkeypatch.setattr(where, name, broken)
    report = build_report(make(*FIXTURES["sales"], "sales")).as_dict()
    note = next(c for c in report["insights"] if c["id"] == f"{part}_unavailable")
    assert note["is_limitation"] and "RuntimeError" in note["explanation"]
    assert report["summary"]["column_types"] and "data_quality" in report


def test_report_of_pasted_text(spark):
    table = scan_text(spark, "name,name,empty,val\n" + "".join(f"a{i},b,,{i}\n" for i in range(25)))
    stored = write_with_row_ids(table, scratch_path(spark, "pasted"))
    report = build_report(Dataset.of(stored, name="pasted")).as_dict()
    assert report["summary"]["column_types"] == {"name": "text", "name_1": "text", "empty": "text", "val": "number"}
