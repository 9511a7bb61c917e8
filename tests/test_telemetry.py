"""Plans and odd rows of the reports on discovery and headlines."""

from pressloom.operators import telemetry


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_prices_come_without_a_join(spark):
    """Rows of few models are not brought to one task each, and those without a model are in no report."""
    rows = [(1, 1, m, True, None, 1_000_000, 0, 5) for m in ("gpt-4o-mini-x", "gpt-4o", "gpt-4o", None)]
    attempts = spark.createDataFrame(rows, "article_id long, attempt_idx int, model string, accepted boolean, reason string, input_tokens long, output_tokens long, latency_ms long")
    assert "Join" not in plan_of(telemetry.model_price(attempts))
    assert {r.model: (r.n, round(r.cost_usd, 6)) for r in telemetry.arm_summary(attempts).collect()} == {"gpt-4o-mini-x": (1, 0.15), "gpt-4o": (2, 5.0)}


def test_first_occurrences_work_out_a_key_once(spark):
    rows = [(1, 1, "http://A.example.com/x?utm_source=1", "t"), (1, 2, "http://a.example.com/x", "t"), (1, 3, "", " T "), (1, 4, None, "t"), (1, 5, None, " "), (2, 1, "no url", None), (2, 2, "", None)]
    found = telemetry.first_occurrence(spark.createDataFrame(rows, "search_id long, rank int, url string, title string"), title="title")
    assert sorted((r.search_id, r["rank"], r.duplicate) for r in found.collect()) == [(1, 1, False), (1, 2, True), (1, 3, False), (1, 4, True), (2, 1, False)]
    plain = telemetry.first_occurrence(spark.range(1).selectExpr("id AS search_id", "1 AS rank", "concat('http://', id) AS url"))
    assert not [line for line in plan_of(plain).splitlines() if "Filter" in line and "regexp_extract" in line]
