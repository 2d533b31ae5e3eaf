import math
import random

from perievent.plans.experiment import Experiment


def test_planted_cells_respond(spark):
    """Cell 0 answers config 2, cell 1 nothing, cell 2 everything."""
    rng = random.Random(0)
    rows = []
    for cell in range(3):
        for config in range(4):
            for rep in range(6):
                for f in range(20):
                    up = 5.0 if 8 <= f < 14 and (cell == 2 or cell == 0 and config == 2) else 0.0
                    rows.append((cell, config * 10 + rep, config, f, 10 + rng.gauss(0, 0.5) + up))
    x = Experiment(spark.createDataFrame(rows, "cell long, trial long, config long, frame_ix long, value double"), spark.createDataFrame([(k, k * 10) for k in range(4)], "config long, size long"), degrees=90.0)
    m = {(r["cell"], r["trial"]): r for r in x.get_trial_metrics().collect()}
    assert len(m) == 72 and abs(m[0, 20]["df"] - 5) < 1 and abs(m[1, 20]["df"]) < 1 and math.isclose(m[0, 20]["dff"], m[0, 20]["df"] / m[0, 20]["base_mean"])
    assert {r["cell"] for r in x.get_responsive_cells(0.8).collect()} == {0, 2}
    assert max(x.get_selective_cells().collect(), key=lambda r: r["h"])["cell"] == 0
    s = {r["cell"]: r for r in x.get_selectivity().collect()}
    assert abs(s[0]["theta"] - 180) < 10 and s[0]["sparseness"] > s[2]["sparseness"]
    assert x.select(spark.createDataFrame([(2,)], "cell long")).get_stats().count() == 4
    assert x.get_with_stimuli().filter("size = 20").count() == 18 and x.get_psth().count() == 240
