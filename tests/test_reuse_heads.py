"""Rounds over the first candidates of each claim against the sequential rule."""

import pytest

from sparkloom.operators import reuse
from tests.test_reuse import candidates, frame, selected, sequential


@pytest.mark.parametrize("held", [1, 2, 5])
def test_claims_that_choose_beyond_their_first_candidates(spark, monkeypatch, held):
    rows = candidates(4, 3, 7, 12, 3, 6)
    monkeypatch.setattr(reuse, "HELD", held)
    assert selected(frame(spark, rows)) == sequential(rows)


def test_rounds_see_the_first_candidates_only(spark, monkeypatch):
    """Every round read all candidates of .14 below the best."""
    sizes, written = {}, reuse._written

    def count(df, name):
        out = written(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(reuse, "_written", count)
    one = candidates(4, 1, 1, 12, 3, 6)[0]
    rows = [one | {"task_id": 1, "claim_no": c, "relation": "support", "rank_score": 0.9, "candidate_id": f"{k:04d}", "chunk_id": f"c{k}", "span_key": f"s{k}", "content_key": f"h{c}-{k % 7}"} for c in range(3) for k in range(1500)]
    assert selected(frame(spark, rows)) == sequential(rows)
    assert sizes["reuse-pool"] == [3 * (reuse.HELD + 1)]
