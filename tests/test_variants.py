"""Score variants with the real detectors, against each representation on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.reconstruction import apply_tail, fit_subspace, reconstruction_errors, residual_scales, row_error
from millrace.operators.vectors import apply_scaler, fit_scaler
from millrace.plans.variants import SCORES, Representation, frozen_cuts, long_scores, represented, score_representations, with_frozen_supplement
from millrace.session import settle

KINDS = [Representation("pooled", False, "standard"), Representation("own_even", True, "robust", lambda i: i % 2 == 0)]


def test_every_variant_equals_its_own_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"c{i % 2}", i % 5, (rng.normal(size=6) * [1, 2, 3, 1, 1, 9]).tolist()) for i in range(240)]
    table = settle(spark.createDataFrame(rows, "id int, asset_class string, part int, vector array<double>"), "rows")
    fit, stop, reference = F.col("part") < 2, F.col("part") == 2, F.col("part") == 3
    scored = settle(score_representations(represented(table, KINDS), ["id"], fit, stop, reference, latent=2, trees=12), "scored")
    assert scored.count() == 480 and scored.filter("mean_ensemble < 0 OR mean_ensemble > 1").isEmpty()
    got = {(r.representation, r.id): r for r in scored.collect()}
    for kind, key, keep in (("pooled", None, range(6)), ("own_even", "asset_class", range(0, 6, 2))):
        one = table.withColumn("g", F.col(key) if key else F.lit("all")).withColumn("vector", F.array(*[F.get("vector", F.lit(k)) for k in keep]))
        name = "standard" if kind == "pooled" else "robust"
        scaled = settle(apply_scaler(one, fit_scaler(one.filter(fit), ["g"], name), ["g"]), "one")
        errors = settle(reconstruction_errors(scaled, settle(fit_subspace(scaled.filter(fit), 2, "g"), "s"), "g"), "e")
        tails = {r.id: r for r in apply_tail(errors, residual_scales(errors.filter(stop), "g"), "g").withColumn("mean", row_error(F.col("errors"))).collect()}
        for column, raw in (("mean_ae", lambda r: r["mean"]), ("tail_ae", lambda r: r["tail"]["score"])):
            for i, c, _, _ in rows:
                group = [j for j, d, p, _ in rows if p == 3 and (key is None or d == c)]
                share = np.mean([raw(tails[j]) <= raw(tails[i]) + 1e-12 for j in group])
                assert getattr(got[kind, i], column) == pytest.approx(share, abs=1.01 / len(group))
    long_form = long_scores(scored, ["id"])
    assert long_form.count() == 480 * len(SCORES)
    assert frozen_cuts(long_form).count() == 2 * len(SCORES)
    both = with_frozen_supplement(scored, ["id"], ("pooled", "mean_ensemble"), ("own_even", "tail_ae")).collect()
    assert len(both) == 240 and all(r.fused == max(got["pooled", r.id].mean_ensemble, got["own_even", r.id].tail_ae) for r in both)
    with pytest.raises(Exception, match="."):
        with_frozen_supplement(scored.filter("NOT (representation = 'own_even' AND id = 3)"), ["id"], ("pooled", "mean_ensemble"), ("own_even", "tail_ae")).collect()
