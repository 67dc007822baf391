import pytest

from millrace.plans import analysis
from millrace.sources import views


def test_builds_are_joined_once(spark, sf_dir, monkeypatch):
    """What the gate, cells and replicates read is no longer the joins that builds are made of."""
    seen = []

    def stop(builds, *rest):
        seen.append(builds._jdf.queryExecution().optimizedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(analysis.prepare, "derive_gate", stop)
    with pytest.raises(InterruptedError):
        analysis.compute(views.builds(spark, sf_dir), None, analysis.Params(as_of=views.AS_OF))
    assert "Join" not in seen[0] and "Relation" not in seen[0]
