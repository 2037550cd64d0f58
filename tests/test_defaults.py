"""The screening queries run the operators with their own defaults."""

import inspect

from sigscreen.plans.screen import screen
from sigscreen.workload import screening as S
from sigscreen.workload.registry import QUERIES


def test_queries_do_the_whole_default_job(spark, monkeypatch):
    full = inspect.signature(screen).parameters["n_perm"].default
    assert S.PERMS == full == 30
    for name in ("permuted_labels", "permutation_null", "permutation_null_numeric", "null_p95", "verdicts"):
        assert f"generate_series(1, {full})" in QUERIES[name].sql

    seen = []

    class Noted(Exception):
        pass

    def note(*args, **settings):
        seen.append(settings)
        raise Noted

    monkeypatch.setattr(S.B, "out_of_fold", note)
    monkeypatch.setattr(S.B, "permutation_importance", note)
    monkeypatch.setattr(S, "screen", note)
    for name in ("out_of_fold", "permutation_importance", "screen", "screen_summary", "rescreen"):
        try:
            QUERIES[name].run(spark, "/root/testdata/sf0.001")
        except Noted:
            continue
        raise AssertionError(name)
    assert len(seen) == 5
    assert all(not {"trees", "depth", "charts"} & set(s) and s.get("n_perm", full) == full for s in seen)
