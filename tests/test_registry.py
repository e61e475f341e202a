import pytest

from phenoweave.operators import nmf, stability, sweeps
from phenoweave.plans import registry, roles

#: Query, the operator it calls, and what it may give besides the entries.
WHOLE = [
    (registry.nmf_regularized, nmf, "factorize_regularized", (4,), {"alpha": 1.0, "l1_ratio": 0.5}),
    (registry.nmf_error_curve, nmf, "error_curve", (4,), {}),
    (registry.stanmf_table, stability, "stability_table", (), {}),
    (registry.stanmf_select, stability, "stable_factorization", (), {}),
    (registry.k_vs_silhouette, sweeps, "silhouette_by_k", (), {}),
    (registry.optimal_k, sweeps, "optimal_k", (), {}),
    (registry.grid_search, sweeps, "grid_search", (), {}),
    (registry.silhouette_chart, sweeps, "silhouette_charts", (), {}),
]


@pytest.mark.parametrize("query, module, name, given, options", WHOLE, ids=[w[0].__name__ for w in WHOLE])
def test_searches_without_sql_run_the_defaults(monkeypatch, query, module, name, given, options):
    class Called(Exception):
        pass

    def stop(entries, *args, **kwargs):
        raise Called(args, kwargs)

    monkeypatch.setattr(module, name, stop)
    for role in ("entries", "quantities"):
        monkeypatch.setattr(roles, role, lambda spark, d: None)
    with pytest.raises(Called) as call:
        query(None, None)
    assert call.value.args == (given, options)

