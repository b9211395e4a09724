"""The text operators on executors that start without the package on their path."""

from __future__ import annotations

from cluster import counts

NAMES = ["p1_found", "p3_found", "p4_found", "p6_found", "p7_found", "p8_mix", "p9_found"]


def test_queries_run_on_executors_without_a_python_path(tmp_path):
    got = counts(NAMES, tmp_path)
    assert sorted(got) == sorted(NAMES) and all(got.values()), got
