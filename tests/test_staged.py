"""Registration as tables gives the transforms of registration on arrays."""

import numpy as np
import pandas as pd
import pytest

from rasterloom.operators import points
from rasterloom.plans import registration, scenes, staged
from rasterloom.plans.config import RegistrationConfig


def table(spark, images):
    rows = []
    for name, img in images.items():
        y, x = np.indices(img.shape)
        rows.append(pd.DataFrame({"image": name, "y": y.ravel(), "x": x.ravel(), "v": img.ravel().astype(float)}))
    return spark.createDataFrame(pd.concat(rows)).repartition(4)


def test_pairs_through_tables(spark):
    """A shift and a pair of a double pixel size, beside one without a raster, one that shows something else, and a flat one."""
    size = 192
    cases = {k: v for k, v in scenes.cases(size).items() if k in ("A", "C")}
    other = scenes.terrain(64, 7)
    sources = {k: v[0] for k, v in cases.items()} | {"alone": other, "flat": np.full((40, 50), 9.0)}
    references = {k: v[1] for k, v in cases.items()} | {"flat": np.full((40, 50), 9.0)}
    pairs = spark.createDataFrame([(k, 1.0, float(cases[k][3]) if k in cases else 1.0) for k in ("A", "C", "alone", "flat", "nowhere")], "pair_id string, s_res double, r_res double")
    config = RegistrationConfig(illumination_method="clahe", transform_type="affine")
    results, used, warped = staged.register_tables(table(spark, sources), table(spark, references), pairs, config)
    found = {r.pair_id: r for r in results.collect()}
    assert {k: (r.success, r.stage) for k, r in found.items()} == {"A": (True, None), "C": (True, None), "alone": (False, "load"), "nowhere": (False, "load"), "flat": (False, "match")}
    for k, (a, b, truth, px, _) in cases.items():
        wanted = registration.register_arrays(a, b, config, 1.0, px)
        m = np.array(found[k].m).reshape(3, 3)
        assert scenes.point_error(wanted["m"], m, size)[0] < 0.01
        if truth is not None:
            assert scenes.point_error(truth, m, size)[0] < 0.1
        metrics = wanted["metrics"]
        assert found[k].ssim == pytest.approx(metrics["ssim"], abs=2e-3) and found[k].nmi == pytest.approx(metrics["mutual_information"], abs=2e-2)
        assert found[k].n == used.where(f"pair_id = '{k}'").count() >= 10
        assert warped.where(f"image = '{k}'").count() == b.size
        assert 0 < found[k].q_score <= 1 and 0 < found[k].spatial <= 1 and found[k].rmse < 1
    assert not {r.image for r in warped.select("image").distinct().collect()} - set(cases)
    with pytest.raises(NotImplementedError):
        staged.register_tables(None, None, pairs, RegistrationConfig(detection_method="superpoint"))


def test_pairs_have_blocks_of_their_own(spark, monkeypatch):
    """One large pair does not multiply the rows of small ones, and all matches are those of one block."""
    monkeypatch.setattr(points, "SIDE", 50)
    rng = np.random.default_rng(3)
    rows = {s: [(p, k, rng.normal(size=4).tolist()) for p, n in (("big", 260), ("s1", 3), ("s2", 7)) for k in range(n)] for s in "ab"}
    a, b = (spark.createDataFrame(rows[s], "pair_id string, idx long, descriptor array<double>") for s in "ab")
    got = {(r.pair_id, r.source_idx, r.reference_idx) for r in points.ratio_match(a, b, 0.95).collect()}
    assert got == {(r.pair_id, r.source_idx, r.reference_idx) for r in points.ratio_match(a, b, 0.95, blocks=1).collect()}
    assert {p for p, *_ in got} == {"big", "s1", "s2"}
