import numpy as np
import pyarrow as pa

from voltlake.functions import kernels
from voltlake.operators import batches, signal
from voltlake.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_slices_are_the_same_rows_and_of_a_bounded_size():
    rows = [[1.0] * n for n in (3, 0, 4, 9, 1)] + [None, [2.0, None], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.float64()))], ["k", "samples"])
    got = list(batches.sliced([batch, batch.slice(2), batch.slice(0, 0)], limit=5))
    assert [x for b in got for x in b.column("k").to_pylist()] == [*range(8), *range(2, 8)]
    assert [x for b in got for x in b.column("samples").to_pylist()] == rows + rows[2:]
    assert all(b.num_rows == 1 or sum(len(x or []) for x in b.column("samples").to_pylist()) <= 5 for b in got)
    assert [len(x) for x in batches.arrays(batch.column("samples"))] == [len(x or []) for x in rows]
    assert batches.lists([np.ones(2), np.zeros(0)]).to_pylist() == [[1.0, 1.0], []]


def test_a_filtered_signal_keeps_no_transform_alive():
    assert kernels.notch(np.ones(64), 128.0, 50.0).base is None


def test_nulls_and_what_a_kernel_cannot_take_pass_through_in_slices(spark, monkeypatch):
    rows = [("f", 128.0, "a", [float(i % 7) for i in range(300)]), ("f", 128.0, "b", None), ("f", 40.0, "c", [1.0, 2.0, 4.0])]
    frame = spark.createDataFrame(rows, "filename string, sfreq double, channel string, samples array<double>")
    got = {r.channel: (r.samples, r.bandpass_error is None) for r in signal.fir_bandpass(frame, 1.0, 40.0).collect()}
    assert np.allclose(got["a"][0], kernels.fir_bandpass(np.array(rows[0][3]), 128.0, 1.0, 40.0)) and got["a"][1]
    assert got["b"] == (None, True) and got["c"] == ([1.0, 2.0, 4.0], False)


def test_psd_treatments_read_signals_once_by_one_worker_a_task(spark):
    assert python_steps(QUERIES["psd_treatments"](spark, SF_DIR)) == 1


def test_long_features_filter_once_and_measure_once(spark):
    assert python_steps(QUERIES["notebook_long_features"](spark, SF_DIR)) == 2
