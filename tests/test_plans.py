"""The physical plans the operators rely on."""

import re

import pytest

from thresher.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["first_per_class", "first_per_digest", "hardest_by_category", "round_robin_pages", "quota_with_topup", "capped_arrivals"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit.*Partial", text)


@pytest.mark.parametrize("name", ["hardest_overall", "seeded_sample", "exact_seeded_sample"])
def test_whole_table_top_k_keeps_a_heap(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_scan_reads_only_what_it_needs(spark):
    text = plan(spark, "pruned_scan")
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThanOrEqual(n_chars,500)]" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text


@pytest.mark.parametrize("name", ["classification_report", "roc_area", "recall_threshold_by_misses", "precision_recall_curve"])
def test_scores_are_counted_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "partial_sum" in text or "partial_count" in text
    # Every window is split by value range; none orders the whole table in one task.
    for window in re.findall(r"\+- Window \[(.*?)\], \[(.*?)\]", text):
        assert window[1].strip()


@pytest.mark.parametrize("name", ["confusion_by_split_and_category", "conditional_counts", "leaking_groups", "table_fingerprint"])
def test_reports_shuffle_once(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"\bExchange ", text)) <= 2


def test_no_python_in_expression_queries(spark):
    for name, query in QUERIES.items():
        if re.search(r"\bB\d", query.survey) and not name.startswith(("public_", "page_", "screenshot_", "aligned", "build", "mine", "cascade_r")):
            assert "Python" not in plan(spark, name), name
