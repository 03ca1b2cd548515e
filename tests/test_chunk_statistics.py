"""Statistics of a clip's series leave its chunks as one row each, and chunks are spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import soundvector

NAMES = soundvector.series_names(20, 128, (43, 86))


def chunks(spark, clips, chunk):
    rows = [(c, t, float(v)) for c, x in clips.items() for t, v in enumerate(x)]
    sent = soundvector.chunked_samples(spark.createDataFrame(rows, "clip bigint, t int, x double"), 16, 4, chunk=chunk, halo=4)
    work = soundvector.ChunkSeries(16, 4, 22050, 128, 20, 5, chunk, 4)
    return soundvector.frame_values(sent, work), soundvector.chunk_statistics(sent, work, NAMES, soundvector.MEDIANS)


@pytest.mark.parametrize("chunk", [256, 8])
def test_merged_statistics_are_those_of_all_frames(spark, chunk):
    rng = np.random.default_rng(9)
    clips = {1: rng.normal(size=64), 2: rng.normal(size=200), 3: rng.normal(size=24)}
    clips[2][7] = np.nan  # values that are not numbers count nowhere
    frames, told = chunks(spark, clips, chunk)
    stats, middle = soundvector.merged_statistics(told.cache())
    ids = {n: i for i, n in enumerate(dict.fromkeys(NAMES))}
    got = {(r["clip"], r["series"]): [r["mean"], r["std"], r["max"], r["min"]] for r in stats.collect()}
    medians = {(r["clip"], r["series"]): r["median"] for r in middle.where(F.col("series").isin([ids[n] for n in soundvector.MEDIANS])).collect()}
    whole = {c: np.array([r["v"] for r in frames.where(F.col("clip") == c).collect()], dtype=float) for c in clips}
    of, seen = np.array([ids[n] for n in NAMES]), 0
    for c, block in whole.items():
        for n, s in ids.items():
            v = block[:, of == s].ravel()
            v = v[~np.isnan(v)]
            assert ((c, s) in got) == bool(len(v))
            if len(v):
                np.testing.assert_allclose(got[c, s], [v.mean(), v.std(), v.max(), v.min()], rtol=1e-9, atol=1e-9)
                seen += 1
                if n in soundvector.MEDIANS:
                    assert medians[c, s] == pytest.approx(np.median(v))
    assert seen == len(got)


def test_a_chunk_leaves_one_row_and_chunks_keep_their_tasks(spark):
    _, told = chunks(spark, {c: np.ones(64) for c in range(40)}, 256)
    assert told.count() == 40 and told.where("alone and loose is null and size(n) = 121").count() == told.where("size(onset) = 13").count() == 40
    # few bytes, but clips are not merged into one task
    assert told.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
