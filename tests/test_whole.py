"""Queries over whole tables against brute force."""

import numpy as np

from cadenza.plans import imu_queries, registry
from cadenza.plans.tables import events, table


def sse(x, y):
    return 0.0 if len(x) < 2 else float(((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2).sum())


def test_prefix_summaries_of_all_events(spark, sf_dir):
    sequences = events(spark, sf_dir).toPandas().sort_values("i").groupby("user_id")["value"]
    got = registry.QUERIES["seq_prefix_summaries"](spark, sf_dir).toPandas().set_index(["user_id", "up_to_rep"])
    assert got.index.is_unique and len(got) == sequences.size().sum() and sequences.size().max() > 12
    for user, y in list(sequences)[:3]:
        for last in range(len(y)):
            part, x, row = y.to_numpy()[: last + 1], np.arange(last + 1.0), got.loc[(user, last)]
            if last >= 1:
                line = np.polyfit(x, part, 1)
                np.testing.assert_allclose([row["slope"], row["max_dev"]], [line[0], np.abs(part - np.polyval(line, x)).max()], atol=2e-6)
                np.testing.assert_allclose(row["total_change"], (part[-1] - part[0]) / part[0], atol=2e-6)
            if last >= 2:
                np.testing.assert_allclose(row["curvature"], np.polyfit(x, part, 2)[0], atol=2e-6)
            if last >= 3:
                two = {k: sse(x[:k], part[:k]) + sse(x[k:], part[k:]) for k in range(2, last)}
                best = min(two, key=two.get)
                assert row["breakpoint"] == best + 1
                np.testing.assert_allclose(row["breakpoint_gain"], 1 - two[best] / sse(x, part), atol=2e-6)


def test_concordance_of_all_pairs(spark, sf_dir):
    got = registry.QUERIES["completed_concordance"](spark, sf_dir).toPandas().set_index("user_id")
    sequences = events(spark, sf_dir).toPandas().sort_values("i").groupby("user_id")["value"]
    assert sequences.size().max() > 20 and set(got.index) == set(sequences.groups)
    for user, y in sequences:
        a, b = (y.to_numpy()[k] for k in np.triu_indices(len(y), 1))
        gain = np.where(np.abs(a - b) <= 1e-8 + 1e-5 * np.abs(b), 0.5, a < b)
        assert got.loc[user, "pairs"] == len(a)
        np.testing.assert_allclose(got.loc[user, "concordance"], gain.mean(), atol=1e-6)


def test_lookup_of_every_line(spark, sf_dir):
    got = registry.QUERIES["metadata_lookup"](spark, sf_dir).toPandas()
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().orderBy("l_orderkey").collect()
    want = [(r[0], k, f"{r[0]}:rep{k:03d}") for r in per for k in range(1, r[1] + 1)]
    assert list(got.itertuples(index=False, name=None)) == want


def warping(a, b):
    w = np.full((len(a) + 1, len(b) + 1), np.inf)
    w[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            w[i + 1, j + 1] = abs(a[i] - b[j]) + min(w[i, j], w[i, j + 1], w[i + 1, j])
    return w[-1, -1] / (len(a) + len(b))


def test_whole_vectors(spark, sf_dir):
    vectors = {r[0]: np.array(r[1], float) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()}
    far = registry.QUERIES["vector_dtw"](spark, sf_dir).toPandas().set_index("vec_id")["distance"]
    curves = registry.QUERIES["vector_resample"](spark, sf_dir).toPandas().sort_values("pos").groupby("vec_id")["v"]
    assert set(far.index) == set(vectors) == set(curves.groups)
    for key in sorted(vectors)[:40]:
        v = vectors[key]
        np.testing.assert_allclose(far[key], warping(v[: len(v) // 2], v[len(v) // 2 :]), atol=2e-6)
        curve = curves.get_group(key).to_numpy()
        np.testing.assert_allclose(curve, np.interp(np.linspace(0, len(v) - 1, 96), np.arange(len(v)), v), atol=2e-6)
        assert abs(curve[-1] - v[-1]) < 2e-6


def test_plans_stay_linear(spark, sf_dir):
    """No frame that runs to the end of its key, and no row for each pair of a cut and a value."""
    for name in ("seq_uniform_resample", "seq_points_in_gaps", "seq_zupt_velocity", "seq_retro_trajectory", "form_pointers", "narrative_execution"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "UnboundedFollowing" not in plan.replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "").replace("currentrow$(), unboundedfollowing", "UnboundedFollowing"), name
        assert "sequence(2" not in plan, name


def test_every_gate_of_every_layer(spark):
    got = imu_queries.full_metrics(spark, 8, 4, (5,)).toPandas()
    assert got.groupby("layer", sort=False).size().to_dict() == {"conditioning": 2, "segmentation": 2, "form": 1, "rir": 4, "rpe": 3, "divergence": 2}
    assert got["value"].notna().all() and got.loc[got["threshold"].isna(), "name"].tolist() == ["majority_within_one"]
    assert got.loc[got["layer"].isin(["conditioning", "segmentation", "form"]), "passed"].all()


def test_predictions_take_every_corpus(spark, monkeypatch):
    hazard, effort, asked = imu_queries._hazard_model(spark, 5, 6, 3), imu_queries._rpe_model(spark, 5, 6, 3), []
    monkeypatch.setattr(imu_queries, "_hazard_model", lambda _, *sizes: asked.append(sizes) or hazard)
    monkeypatch.setattr(imu_queries, "_rpe_model", lambda _, *sizes: asked.append(sizes) or effort)
    for name, held in (("rir_hazard_predictions", hazard[2]), ("rpe_ordinal_predictions", effort[2])):
        assert registry.QUERIES[name](spark, "").groupBy("seed").count().toPandas().set_index("seed")["count"].to_dict() == dict.fromkeys((5, 11, 23), held.count())
    assert asked == 2 * [(5, 24, 6), (11, 24, 6), (23, 24, 6)]
