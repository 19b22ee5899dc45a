import numpy as np
import pytest

from eventloom import registry, workflow
from eventloom.sources import mda, text
from eventloom.streaming import events as streaming


@pytest.mark.parametrize("kind", sorted(mda.NAMES))
def test_array_round_trip(tmp_path, kind):
    x = np.random.default_rng(0).integers(0, 100, (3, 4, 2))
    mda.write_array(f"{tmp_path}/a.mda", x, kind)
    assert (mda.read_array(f"{tmp_path}/a.mda") == x).all()
    mda.convert_type(f"{tmp_path}/a.mda", f"{tmp_path}/b.mda", "float64")
    assert (mda.read_array(f"{tmp_path}/b.mda") == x).all()


def test_raw_and_bad_headers(tmp_path):
    (tmp_path / "raw").write_bytes(np.arange(12, dtype="<i2").tobytes())
    mda.convert_raw(f"{tmp_path}/raw", f"{tmp_path}/x.mda", "int16", (3, 0))
    assert mda.read_array(f"{tmp_path}/x.mda").shape == (3, 4)
    with pytest.raises(ValueError):
        mda.convert_raw(f"{tmp_path}/raw", f"{tmp_path}/y.mda", "int16", (5, 2))
    with pytest.raises(ValueError):
        mda.read_header(np.array([7, 4, 1, 1], "<i4").tobytes())


def test_data_source(spark, tmp_path, monkeypatch):
    mda.register(spark)
    x = 1 + np.sin(np.arange(4)[:, None] + np.sin(np.arange(50)))
    mda.write_array(f"{tmp_path}/in.mda", x)
    df = spark.read.format("mda").load(f"{tmp_path}/in.mda")
    assert df.count() == 200 and df.where("channel = 2 and t = 7").first().value == x[1, 7]
    mda.write_mda(df, f"{tmp_path}/out.mda", 4, 50)
    assert (mda.read_array(f"{tmp_path}/out.mda") == x).all()
    assert not list(tmp_path.glob("*.npz"))


def test_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1, 2.5\n\n3,no\n")
    got = sorted(tuple(r) for r in text.read_numbers(spark, f"{tmp_path}/a.csv").where("value is not null").collect())
    assert got == [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 2.5)]
    series = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 2, 0, 2.5), ("a", 1, 1, 3.0), ("a", 2, 1, 4.0), ("b", 1, 0, 9.0), ("b", 3, 2, 8.0)], "recording_id string, channel int, t bigint, value double")
    lines = lambda df: [tuple(r) for r in df.orderBy("recording_id", "row").select("recording_id", "line").collect()]
    assert lines(text.as_lines(series)) == [("a", "1\t2.5"), ("a", "3\t4"), ("b", "9\t0"), ("b", "0\t0"), ("b", "0\t8")]
    assert lines(text.as_lines(series, transpose=False, delimiter=",")) == [("a", "1,3"), ("a", "2.5,4"), ("b", "9,0,0"), ("b", "0,0,8")]
    text.write_lines(text.as_lines(series), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/recording_id=a").collect()) == ["1\t2.5", "3\t4"]
    with pytest.raises(ValueError):
        text.as_lines(series, max_rows=1)


def test_registry(spark):
    operators = registry.register_all()
    assert {"detect", "compute_templates", "filter_events", "shred", "flag_readings"} <= set(operators)
    with pytest.raises(TypeError):
        operators["detect"].check({"series": None}, {"clip_size": 1, "interval": 1})
    with pytest.raises(TypeError):
        operators["filter_events"].check({"firings": None}, {"nothing": 1})
    assert operators["filter_events"].spec()["inputs"] == ["firings"]


def test_pipeline(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, t, float(t)) for t in range(30)], "recording_id string, channel int, t bigint, value double")
    p = workflow.Pipeline(spark, f"file://{tmp_path}")
    p.source("raw", df, "1")
    p.add("normalize_channels", {"series": "raw"}, {}, "n", keep=True)
    p.add("value_range", {"series": "n"}, {}, "range")
    first = p.run()["range"].first()
    assert first.vmax > 0 and len(list(tmp_path.iterdir())) == 1
    assert p.run()["range"].first() == first and p.provenance().count() == 2
    q = workflow.Pipeline(spark)
    q.source("raw", df, "2")
    q.add("normalize_channels", {"series": "raw"}, {}, "n")
    assert q.keys()["n"] != p.keys()["n"]
    q.add("normalize_channels", {"series": "missing"}, {}, "m")
    with pytest.raises(ValueError):
        q.run()
    q.steps[-1].output = "n"
    with pytest.raises(ValueError):
        q.order()


@pytest.mark.parametrize("options", [{}, {"whiten": False, "noise_level": 0.3}])
def test_sort_pipeline_is_whole(spark, tmp_path, options):
    from eventloom.operators import joins
    from eventloom.sources.synthetic import synthesize

    s, _ = synthesize(spark, units=3, channels=3, samples=30_000, noise_level=0.5)
    p = workflow.sort_pipeline(spark, s, joins.linear_adjacency(s, 2), 30_000.0, cache=f"file://{tmp_path}", **options)
    names = [step.operator for step in p.order()]
    assert names.index("branch_cluster") < names.index("merge_across_channels_v2") < names.index("fit_stage") < names.index("cluster_metrics")
    assert ("whiten" in names) == (not options) and ("add_noise" in names) == bool(options)
    r = p.run()
    fitted = {(f.channel, f.time): f.label for f in r["firings"].collect()}
    labels = set(fitted.values())
    assert labels == set(range(1, len(labels) + 1)) and 0 < len(fitted) <= r["merged"].count() <= r["clustered"].count()
    metrics = {m.label: m for m in r["cluster_metrics"].collect()}
    assert set(metrics) == labels and all(m.peak_amp > 0 and 0 <= m.noise_overlap <= 1 for m in metrics.values())
    assert all({m.label1, m.label2} <= labels and m.label1 != m.label2 for m in r["cluster_pair_metrics"].collect())


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(600)
    df = spark.createDataFrame([("r", 1, t, float(v)) for t, v in enumerate(x)], "recording_id string, channel int, t bigint, value double")
    for i in range(3):
        df.where(f"t div 200 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streaming.detect_stream(stream, 2.0, 10).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r.t for r in spark.table("found").collect())
    from eventloom.kernels.pursuit import detect

    assert got == detect(np.abs(x), 2.0, 10).tolist()[:-1]
