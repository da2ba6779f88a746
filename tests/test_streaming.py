"""Online least squares against batch fits, over restarts, late and repeated rows."""

import numpy as np

from vectide.functions.design import Lags
from vectide.operators import ols, simulate
from vectide.sources.series import SeriesFrame
from vectide.streaming import online

LAGS = Lags(2)
SCHEMA = "k string, t long, y1 double, y2 double"


def test_a_stream_ends_where_a_batch_fit_does(spark, tmp_path):
    y = {k: simulate.sim_path(np.array([[0.5, 0.1], [0.0, 0.4], [0.2, -0.3]]), np.eye(2), Lags(1), 60, rng=np.random.default_rng(i)) + 1e6 * i for i, k in enumerate("ab")}
    rows = [(k, t + 1, *map(float, y[k][t])) for k in "ab" for t in range(60)]
    order = np.random.default_rng(1).permutation(len(rows))
    source, fits = tmp_path / "in", str(tmp_path / "fits")

    def add(some):
        spark.createDataFrame([rows[i] for i in some], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = online.online_least_squares(stream, ["k"], ["y1", "y2"], LAGS)
        query = out.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(fits)).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    add(order[:50])
    add(order[50:80])
    run()
    add(order[70:])  # ten rows come again
    run()  # a new query, from the checkpoint
    got = {r["k"]: r for r in online.latest(spark.read.parquet(fits), ["k"]).collect()}
    for k in "ab":
        sf = SeriesFrame(spark.createDataFrame([r[1:] for r in rows if r[0] == k], "t long, y1 double, y2 double"), ("y1", "y2"))
        want = ols.fit_ols(sf, LAGS)
        assert (got[k]["t"], got[k]["n"], got[k]["waiting"]) == (60, 58, 0)
        coef = np.reshape(got[k]["coef"], (-1, 2))
        assert np.allclose(coef[:-1], want.coef[:-1], atol=1e-6) and np.allclose(np.reshape(got[k]["sigma"], (2, 2)), want.sigma, rtol=1e-5)


def test_states_wait_for_their_rows():
    y = np.random.default_rng(2).standard_normal((9, 1))
    one = online.advanced(None, {3: y[2], 1: y[0]}, Lags(1), 1)
    assert one[0] == 1 and set(one[3]) == {3}
    two = online.advanced(one, {2: y[1], 1: y[0] + 9}, Lags(1), 1)  # the first row came before
    whole = online.advanced(None, {i + 1: v for i, v in enumerate(y[:3])}, Lags(1), 1)
    assert two[0] == whole[0] == 3 and np.allclose(two[1], whole[1]) and not two[3]
