"""Executors that start without the package on their path must get it from the session."""

from __future__ import annotations

from cluster import counts

NAMES = ["p5_found", "p2_found", "matching_ratios", "catalog_search_terms", "packed_work"]


def test_queries_run_on_executors_without_a_python_path(tmp_path):
    got = counts(NAMES, tmp_path)
    assert sorted(got) == sorted(NAMES) and all(got.values()), got
