import json

from palimpsest.operators import evaluate
from palimpsest.streaming import evaluation


def test_running_counts_equal_the_batch(spark, tmp_path):
    rows = [{"pair_id": 1, "expected": g, "match_type": k} for g, k in [("matched", "exact_match"), ("changed", "partial_match"), ("missing", None), ("extra", "extra_in_target")]]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(r))
    query = evaluation.start(evaluation.running_counts(evaluation.scored_stream(spark, str(tmp_path / "in"))), "counts", str(tmp_path / "state"))
    query.awaitTermination()
    got = {r.label: (r.tp, r.fp, r.fn) for r in spark.table("counts").collect()}
    batch = evaluate.counts(spark.createDataFrame([tuple(r.values()) for r in rows], evaluation.SCHEMA)).collect()
    assert got == {r.label: (r.tp, r.fp, r.fn) for r in batch if (r.tp, r.fp, r.fn) != (0, 0, 0)}
