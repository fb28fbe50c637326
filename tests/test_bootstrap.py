"""The cluster bootstrap against a plain walk by the reference's rule."""

import random
from collections import defaultdict
from statistics import mean

import pytest

from heatline import catalog
from heatline.operators import stats
from heatline.plans import stats as plans

SF = "/root/testdata/sf0.001"


def percentile(ordered, p):
    at = (len(ordered) - 1) * p
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def test_cluster_bootstrap_draws_2000_times_as_many_clusters_as_there_are(spark):
    means = stats.pool_means(plans._pairs(spark, SF).filter("difference IS NOT NULL"), "task", "run", "pool", "difference", ("cluster",)).collect()
    by = defaultdict(lambda: defaultdict(list))
    for r in means:
        by[r["cluster"]][r["run"]].append(r["mean_effect"])
    ids, rng, samples = sorted(by), random.Random(20260727), []
    for _ in range(2000):
        runs = defaultdict(list)
        for _ in ids:
            for run, effects in by[rng.choice(ids)].items():
                runs[run] += effects
        samples.append(mean(map(mean, runs.values())))
    samples.sort()
    got = catalog.queries()["cluster_bootstrap"](spark, SF).collect()[0]
    assert got["lower"] == pytest.approx(percentile(samples, 0.025)) and got["upper"] == pytest.approx(percentile(samples, 0.975))
