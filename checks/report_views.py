"""The evidence report over a table with planted patterns."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.insight_views import (
    busiest_sql, fit_sql, halves_sql, labels_sql, outliers_sql, pairs_sql,
)
from checks.registry import ACTIVITY, activity, query
from veritable import scratch_path
from veritable.operators import profile
from veritable.plans.lens import MODES, apply_lens
from veritable.plans.ranking import follow_ups, key_takeaways, ranked_findings, top_findings
from veritable.plans.report import build_report, section_findings, with_headlines
from veritable.plans.sections import Facts
from veritable.sources.sinks import load_report, save_report


def _confidence(n, effect):
    return f"round(greatest(0.0, least(1.0, least(1.0, {n} / 50.0) * greatest(0.0, least(1.0, {effect})))), 3)"


def _trust(n, missing, consistency):
    return (
        f"CAST(round_even(100 * least(1.0, {n} / 50.0) * greatest(0.0, 1.0 - greatest(0.0, {missing})) "
        f"* greatest(0.0, least(1.0, {consistency})), 0) AS INTEGER)"
    )


def _cited(predicate="TRUE", order="__rowid", limit=25, table="activity"):
    return (
        f"(SELECT string_agg(__rowid, ',' ORDER BY place) FROM (SELECT __rowid, "
        f"row_number() OVER (ORDER BY {order}) AS place FROM {table} WHERE {predicate} "
        f"ORDER BY place LIMIT {limit}))"
    )


def _finding(order, id, category, n, effect, missing, consistency, notability, cited, question, source):
    return (
        f"SELECT {order} AS ord, {id} AS id, '{category}' AS category, {_confidence(n, effect)} AS confidence, "
        f"{_trust(n, missing, consistency)} AS trust_score, FALSE AS is_limitation, "
        f"CAST({notability} AS DOUBLE) AS notability, {cited} AS evidence, {question} AS question FROM {source}"
    )


def _anomaly(order, column):
    far = f'(SELECT (q1 + q3) / 2 FROM stats WHERE "column" = \'{column}\')'
    beyond = (
        f'{column} < (SELECT lower_fence FROM stats WHERE "column" = \'{column}\') '
        f'OR {column} > (SELECT upper_fence FROM stats WHERE "column" = \'{column}\')'
    )
    fraction = '(outliers / "values")'
    return _finding(
        order, f"'anomaly_{column}'", "anomalies", '"values"', f"least(1.0, {fraction} / 0.05)", "0.0",
        f"(1.0 - {fraction})", f"least(1.0, {fraction} / 0.05) * 0.9",
        _cited(beyond, f"abs({column} - {far}) DESC, __rowid"),
        f"'Do the ' || format('{{:,}}', outliers) || ' far values of {column} come from one place or day?'",
        f"stats WHERE \"column\" = '{column}' AND outliers > 0",
    )


_TREND_CITED = (
    f"{_cited(order='ts, __rowid', limit=5)} || ',' || {_cited(order='ts DESC, __rowid', limit=5)}"
)
_PAIR_CITED = (
    f"{_cited(order='value, __rowid', limit=4)} || ',' || {_cited(order='value DESC, __rowid', limit=4)}"
)

_FINDINGS = " UNION ALL ".join([
    _finding(
        1, "'executive_summary'", "executive_summary", "n", "1.0", "kind_missing / 6", "1.0", "0.0",
        _cited(limit=5), "NULL", "t",
    ),
    _finding(
        2, "'missing_data'", "missing_data", "n", "CASE WHEN flagged THEN least(1.0, kind_missing / 0.20) ELSE 0.5 END",
        "0.0", "1.0", "CASE WHEN flagged THEN least(1.0, kind_missing) * 0.6 ELSE 0.0 END",
        f"CASE WHEN flagged THEN {_cited('kind IS NULL')} ELSE '' END",
        "CASE WHEN flagged THEN 'Which rows lack kind, and do they share a source or a period?' END", "t",
    ),
    """SELECT 3 AS ord, 'single_value_' || "column" AS id, 'hidden_patterns' AS category, 0.0 AS confidence,
      15 AS trust_score, TRUE AS is_limitation, 0.0 AS notability, '' AS evidence, NULL AS question
      FROM reported WHERE distinct_values <= 1""",
    _finding(
        4, "'concentration_' || \"column\"", "hidden_patterns", "total", "share", "0.0", "share", "share",
        _cited("channel = (SELECT label FROM reported WHERE \"column\" = 'channel')"),
        "'Would the figures read the same without the rows where ' || \"column\" || ' is ''' || label || '''?'",
        "reported WHERE distinct_values > 1 AND share >= 0.40",
    ),
    _finding(
        5, "'trend'", "hidden_patterns", "n", "r_squared", "0.0", "r_squared", "r_squared", _TREND_CITED,
        "CASE WHEN direction <> 'flat' THEN 'What else was ' || direction || ' while the daily rows by ts were?' END",
        "verdict, t",
    ),
    _finding(
        6, "'time_pattern'", "hidden_patterns", "dated_rows", "effect", "0.0", "effect", "effect * 0.7",
        _cited("dayname(ts) = (SELECT weekday FROM busiest)"), "NULL", "busiest",
    ),
    _finding(
        7, "'correlation_top'", "correlations", "n", "abs(r)", "0.0", "abs(r)", "abs(r)", _PAIR_CITED,
        "'Does the link between value and score hold inside each category as well?'", "pairs",
    ),
    _anomaly(8, "value"),
    _anomaly(9, "score"),
    _finding(
        10, "'what_changed'", "what_changed_most", "(first_rows + second_rows)", "effect", "kind_missing",
        "least(1.0, effect + 0.2)", "effect",
        _cited("kind IS NOT DISTINCT FROM (SELECT label FROM top)"),
        "'Did the other values of kind lose what the top mover won?'", "top, t",
    ),
])

_REPORT = f"""WITH {ACTIVITY},
t AS (SELECT count(*) AS n, round(count(*) FILTER (WHERE kind IS NULL) / count(*), 4) AS kind_missing,
  round(count(*) FILTER (WHERE kind IS NULL) / count(*), 4) >= 0.20 AS flagged FROM activity),
{labels_sql('activity', ['kind', 'channel', 'status'])},
{fit_sql('activity', 'ts')},
{busiest_sql('activity')},
{pairs_sql('activity', ['value', 'score'])},
{outliers_sql('activity', ['value', 'score'])},
{halves_sql('activity', 'ts', 'kind')},
top AS (SELECT label, least(1, abs(delta) / greatest(1, first_half)) AS effect,
  (SELECT sum(first_half) FROM moved) AS first_rows, (SELECT sum(second_half) FROM moved) AS second_rows
  FROM moved ORDER BY abs(delta) DESC, label NULLS LAST LIMIT 1),
found AS (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM ({_FINDINGS})),
eligible AS (SELECT *, count(*) FILTER (WHERE trust_score > 40) OVER () AS strong,
  row_number() OVER (ORDER BY trust_score DESC, notability DESC, place) AS rank FROM found
  WHERE NOT is_limitation AND trust_score > 20 AND notability > 0 AND category <> 'executive_summary'),
tops AS (SELECT * FROM eligible WHERE strong >= 2 AND rank <= 3)"""

_CARD = "id, category, confidence, trust_score, is_limitation, round(notability, 4) AS notability, evidence"


def _cards(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "category", "confidence", "trust_score", "is_limitation",
        F.round("notability", 4).alias("notability"),
        F.concat_ws(",", F.transform("evidence_rows", lambda r: r.cast("string"))).alias("evidence"),
    )


def _findings(spark, folder):
    return section_findings(Facts(activity(spark, folder)))


def _body(findings):
    return findings.where("category <> 'executive_summary'")


_NONE = (
    "SELECT 'top_insights_none' AS id, 'top_insights' AS category, 0.0 AS confidence, 0 AS trust_score, "
    "TRUE AS is_limitation, 0.0 AS notability, '' AS evidence WHERE NOT EXISTS (SELECT 1 FROM tops)"
)
_TOP_CARDS = (
    f"SELECT 'top_insight_' || rank AS id, 'top_insights' AS category, confidence, trust_score, is_limitation, "
    f"round(notability, 4) AS notability, evidence FROM tops UNION ALL {_NONE}"
)


@query("findings_all", f"{_REPORT} SELECT {_CARD} FROM found UNION ALL {_TOP_CARDS}")
def findings_all(spark, folder):
    return _cards(with_headlines(_findings(spark, folder)))


@query("top_findings", f"{_REPORT} {_TOP_CARDS}")
def top_cards(spark, folder):
    return _cards(top_findings(_body(_findings(spark, folder))))


@query("top_findings_ranked", f"{_REPORT} SELECT CAST(rank AS INTEGER) AS rank, id, trust_score FROM tops")
def ranked(spark, folder):
    return ranked_findings(_body(_findings(spark, folder))).select("rank", "id", "trust_score")


# the sentence each kind of headline starts with
_SENTENCES = """CASE id
  WHEN 'correlation_top' THEN 'Rows with a high value tend to have a higher score: a strong pattern, '
    || 'which does not show that one causes the other.'
  WHEN 'time_pattern' THEN (SELECT weekday || ' holds ' || format('{:.0f}%', 100 * share)
    || ' of the dated rows, well above an even share.' FROM busiest)
  WHEN 'missing_data' THEN (SELECT CAST(round(100 * kind_missing, 2) AS VARCHAR)
    || '% of kind is blank, so figures based on it rest on part of the rows only.' FROM t)
  END"""


@query(
    "key_takeaways",
    f"{_REPORT} SELECT CAST(rank AS INTEGER) AS rank, id AS source_insight, {_SENTENCES} AS text FROM tops",
)
def takeaways(spark, folder):
    found = key_takeaways(_body(_findings(spark, folder))).select("rank", "source_insight", "text")
    checked = F.col("source_insight").isin("correlation_top", "time_pattern", "missing_data")
    return found.withColumn("text", F.when(checked, F.col("text")))


def _metric(name):
    return F.get_json_object("supporting_metrics", f"$.{name}")


_REAL = f"CASE WHEN {_trust('\"values\"', '0.0', '(1.0 - outliers / \"values\")')} >= 80 THEN 'true' END"
_METRICS = " UNION ALL ".join(
    f"SELECT '{id}' AS id, '{name}' AS name, CAST({value} AS VARCHAR) AS value FROM {source}"
    for id, name, value, source in [
        ("concentration_channel", "dominant_value", "label", "reported WHERE \"column\" = 'channel' AND distinct_values > 1 AND share >= 0.40"),
        ("concentration_channel", "count", "count", "reported WHERE \"column\" = 'channel' AND distinct_values > 1 AND share >= 0.40"),
        ("concentration_channel", "runner_up", "runner_up", "reported WHERE \"column\" = 'channel' AND distinct_values > 1 AND share >= 0.40"),
        ("single_value_status", "only_value", "label", "reported WHERE \"column\" = 'status' AND distinct_values <= 1"),
        ("trend", "buckets", "buckets", "verdict"),
        ("trend", "direction", "direction", "verdict"),
        ("trend", "first_bucket_count", "first_count", "verdict"),
        ("time_pattern", "busiest_weekday", "weekday", "busiest"),
        ("time_pattern", "dated_rows", "dated_rows", "busiest"),
        ("correlation_top", "n", "n", "pairs"),
        ("anomaly_value", "outlier_count", "outliers", "stats WHERE \"column\" = 'value'"),
        ("anomaly_value", "values_checked", '"values"', "stats WHERE \"column\" = 'value'"),
        ("anomaly_value", "rare_but_real", _REAL, "stats WHERE \"column\" = 'value'"),
        ("anomaly_score", "rare_but_real", _REAL, "stats WHERE \"column\" = 'score'"),
        ("what_changed", "first_half_rows", "first_rows", "top"),
        ("what_changed", "second_half_rows", "second_rows", "top"),
        ("what_changed", "dimension", "'kind'", "top"),
        ("what_changed", "top_movers[0].label", "label", "top"),
    ]
)
# Numbers that are compared to two decimals.
_DECIMALS = " UNION ALL ".join(
    f"SELECT '{id}' AS id, '{name}' AS name, CAST(CAST(round(100 * ({value})) AS BIGINT) AS VARCHAR) AS value FROM {source}"
    for id, name, value, source in [
        ("missing_data", "worst_missing_pct", "100 * kind_missing", "t"),
        ("concentration_channel", "share_pct", "100 * share", "reported WHERE \"column\" = 'channel' AND distinct_values > 1 AND share >= 0.40"),
        ("trend", "slope_per_day", "slope", "verdict"), ("trend", "r_squared", "r_squared", "verdict"),
        ("time_pattern", "busiest_weekday_pct", "100 * share", "busiest"),
        ("correlation_top", "pearson_r", "r", "pairs"), ("correlation_top", "r_squared", "r * r", "pairs"),
        ("anomaly_value", "q1", "q1", "stats WHERE \"column\" = 'value'"), ("anomaly_value", "q3", "q3", "stats WHERE \"column\" = 'value'"),
        ("anomaly_value", "upper_fence", "upper_fence", "stats WHERE \"column\" = 'value'"),
        ("anomaly_value", "max_outlier", "max_outlier", "stats WHERE \"column\" = 'value'"),
        ("anomaly_value", "outlier_pct", "100 * outliers / \"values\"", "stats WHERE \"column\" = 'value'"),
    ]
)


@query("finding_metrics", f"{_REPORT} {_METRICS} UNION ALL {_DECIMALS}")
def finding_metrics(spark, folder):
    fields = {
        "concentration_channel": ["dominant_value", "count", "runner_up"], "single_value_status": ["only_value"],
        "trend": ["buckets", "direction", "first_bucket_count"],
        "time_pattern": ["busiest_weekday", "dated_rows"], "correlation_top": ["n"],
        "anomaly_value": ["outlier_count", "values_checked", "rare_but_real"], "anomaly_score": ["rare_but_real"],
        "what_changed": ["first_half_rows", "second_half_rows", "dimension", "top_movers[0].label"],
    }
    decimals = {
        "missing_data": ["worst_missing_pct"], "concentration_channel": ["share_pct"], "trend": ["slope_per_day", "r_squared"],
        "time_pattern": ["busiest_weekday_pct"], "correlation_top": ["pearson_r", "r_squared"],
        "anomaly_value": ["q1", "q3", "upper_fence", "max_outlier", "outlier_pct"],
    }

    def hundredths(name):
        return F.round(_metric(name).cast("double") * 100).cast("long").cast("string")

    pairs = [
        F.when(F.col("id") == id, F.struct(F.lit(name).alias("name"), read(name).alias("value")))
        for listed, read in ((fields, _metric), (decimals, hundredths)) for id, names in listed.items() for name in names
    ]
    wanted = F.inline(F.array_compact(F.array(*pairs)))
    return _findings(spark, folder).select("id", wanted)


@query(
    "report_reload",
    f"{_REPORT} SELECT {_CARD.replace(', round(notability, 4) AS notability, evidence', '')} FROM found "
    f"UNION ALL SELECT {_CARD.replace(', round(notability, 4) AS notability, evidence', '')} FROM ({_TOP_CARDS})",
)
def report_reload(spark, folder):
    path = scratch_path(spark, "reports")
    save_report(build_report(activity(spark, folder)), path)
    stored = load_report(spark, path, "activity")
    return stored.select("id", "category", "confidence", "trust_score", "is_limitation")


_QUESTIONS = """copies AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (__rowid) FROM activity))
  AS extra FROM activity),
asked AS (SELECT question AS text, min(place) AS place FROM found
  WHERE NOT is_limitation AND question IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'Do the ' || extra || ' repeated rows stand for separate events, or was something loaded twice?', 1000000
  FROM copies WHERE extra > 0)"""


@query("follow_ups", f"{_REPORT}, {_QUESTIONS} SELECT text FROM asked ORDER BY place, text LIMIT 6")
def questions(spark, folder):
    ds = activity(spark, folder)
    duplicates = profile.duplicate_count(ds).first().duplicate_rows
    return follow_ups(_body(section_findings(Facts(ds))), duplicates).select("text")


_MODES = ", ".join(f"('{m}')" for m in MODES)


@query(
    "audience_lens",
    f"{_REPORT} SELECT mode, id, confidence, trust_score, mode IN ('analyst', 'researcher') AND NOT is_limitation "
    f"AND id <> 'executive_summary' AS technical FROM found CROSS JOIN (VALUES {_MODES}) m(mode)",
)
def audience_lens(spark, folder):
    findings = _findings(spark, folder)
    worded = reduce(DataFrame.unionByName, [apply_lens(findings, mode) for mode in MODES])
    technical = F.endswith("explanation", F.lit(")")).alias("technical")
    return worded.where("why_it_matters IS NOT NULL").select(
        "mode", "id", "confidence", "trust_score", technical
    )
