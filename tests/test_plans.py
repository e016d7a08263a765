"""The physical plans are the ones meant: pruned scans, pushed filters, early limits, no Python and no products on hot paths."""

import contextlib
import io

import pytest

from tessera.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


def test_flagship(spark):
    p = plan(spark, "author_catalog")
    assert "TakeOrderedAndProject" in p and "LeftAnti" in p
    assert "PushedFilters: [IsNotNull(p_retailprice)" in p and "p_name" not in p and "l_extendedprice" not in p


@pytest.mark.parametrize("name", ["card_recommenders_top3", "read_next", "list_items_by_recs", "person_topics", "keyword_density"])
def test_top_per_key_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["compare_pairs", "similar_shelves", "survivor_rows", "resolve_ladder", "display_safety", "likely_english", "page_audit", "benchmark_evidence", "owned_pages", "reattribution"])
def test_stays_in_the_jvm_without_products(spark, name):
    p = plan(spark, name)
    assert not any(x in p for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoop"))


def test_only_read_columns_are_scanned(spark):
    p = plan(spark, "survivor_rows")
    assert "l_tax" not in p and "o_totalprice" not in p
