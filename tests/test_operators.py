import hashlib
import io
import json
import tarfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import coerce, dims
from tallyforge.functions import vectors as V
from tallyforge.operators import audio, calibration, decisions, metrics, sampling, tracker
from tallyforge.sources import readers, sinks
from tallyforge.streaming import markers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_label_space():
    assert [k for k, *_ in dims.LABELS] == list(range(23)) and len(set(dims.CODES)) == 23
    assert set(dims.LABEL_REGIONS) == set(dims.REGIONS) and dims.GROUPS["east_africa"] == ("DJ", "KM", "SO")


def test_coercions(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("abc",), ("nan",), (None,), ("1",), ("5.0",), (" 7 ",)], "x string")
    got = df.select(coerce.num(F.col("x")).alias("n"), coerce.num(F.col("x"), "zero").alias("z"), coerce.whole(F.col("x"), 9).alias("w"), coerce.flag(F.col("x")).alias("f")).collect()
    assert [r["n"] for r in got] == [1.5, None, None, None, None, 1.0, 5.0, 7.0]
    assert [r["z"] for r in got] == [1.5, 0, 0, 0, 0, 1.0, 5.0, 7.0]
    assert [r["w"] for r in got] == [9, 9, 9, 9, 9, 1, 9, 7]
    assert [r["f"] for r in got] == [False] * 5 + [True, False, False]


def test_thresholds_never_hold_for_missing_values(spark):
    df = spark.createDataFrame([(0.96, 0.6), (float("nan"), 0.9), (None, 0.9), (0.91, 0.3), (0.95, 0.5)], "s double, m double")
    assert [r[0] for r in df.select(decisions.tier(F.col("s"), F.col("m"))).collect()] == ["strong", "low", "low", "usable", "strong"]


def test_paths_and_names(spark):
    df = spark.createDataFrame([("d/cc=ma/a.tar",), ("d/split=x/cc=eg/cc=sa/a.tar",), ("d/none/a.tar",)], "p string")
    assert [r[0] for r in df.select(coerce.last_step(F.col("p"), "cc")).collect()] == ["MA", "SA", ""]
    assert one(spark, coerce.file_safe(F.lit("a b/é.c"))) == "a_b_é.c"
    assert one(spark, coerce.number_in(F.lit("eval_step_450000_x"), r"_step_(\d+)_")) == 450000
    assert one(spark, coerce.human_bytes(F.lit(1536))) == "1.5KiB"


def test_region_marginals_equal_summed_probabilities(spark):
    logits = np.random.default_rng(7).normal(size=(4, 23))
    df = spark.createDataFrame([(x.tolist(),) for x in logits], "a array<double>")
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    want = np.stack([p[:, [i for i, r in enumerate(dims.LABEL_REGIONS) if r == region]].sum(axis=1) for region in dims.REGIONS], axis=1)
    got = np.array([r[0] for r in df.select(V.softmax(V.region_logits(F.col("a")))).collect()])
    assert np.allclose(got, want, atol=1e-9)


def test_masks_targets_and_biases(spark):
    active = [i != 2 for i in range(23)]
    df = spark.createDataFrame([([float(i) for i in range(23)], [1 / 23] * 23, 3)], "a array<double>, p array<double>, y int")
    masked = df.select(V.masked(F.col("a"), active)).first()[0]
    assert masked[2] == V.LOWEST and masked[:2] + masked[3:] == [float(i) for i in range(23) if i != 2]
    target = df.select(V.masked_target(F.col("p"), F.col("y"), active)).first()[0]
    assert target[2] == 0 and sum(target) == pytest.approx(1)
    assert df.select(V.soft_target(F.lit(None).cast("array<double>"), F.col("y"), 23)).first()[0][3] == 1
    probs = spark.createDataFrame([([0.99 if i == 2 else 0.5 if i == 0 else 1e-5 for i in range(23)],)], "p array<double>")
    assert probs.select(V.argmax(V.biased(F.col("p"), [0.0] * 23, (2,)))).first()[0] == 0
    with pytest.raises(ValueError):
        V.masked(F.col("a"), [False] * 23)


def test_chunk_means(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, [10.0, 14.0])], "s int, v array<double>")
    assert {r["s"]: r["v"] for r in metrics.mean_vectors(df, "s", "v", 2).collect()} == {0: [2.0, 4.0], 1: [10.0, 14.0]}


def test_digest_shards(spark):
    paths = [f"dataset/sample-{i}.tar" for i in range(200)]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(sampling.digest_shard(F.col("p"), F.lit(32))).collect()]
    assert got == [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") % 32 for p in paths]
    assert len(set(got)) > 20


def test_out_of_range_pairs(spark):
    df = spark.createDataFrame([(0, 0), (0, 99), (-100, 1)], "truth int, pred int")
    assert metrics.confusion(df, 2).collect() == [(0, 0, 1)]
    with pytest.raises(Exception, match="out of range"):
        metrics.confusion(df, 2, on_invalid="raise").collect()


def test_gate_holds_on_a_watched_ratio(spark):
    base = spark.createDataFrame([(0.9, 0.9, 0.9, 0.9, 100)], "accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double, n long")
    target = spark.createDataFrame([(0.9, 0.9, 0.91, 0.9, 100)], base.schema)
    ratios = spark.createDataFrame([("KW", 1.0), ("AE", 1.0)], "code string, ratio double")
    good = spark.createDataFrame([("KW", 1.04, 0.8), ("AE", 1.0, 0.9)], "code string, ratio double, f1 double")
    bad = spark.createDataFrame([("KW", 1.20, 0.8), ("AE", 1.0, 0.9)], good.schema)
    assert metrics.released(metrics.gate(base, target, ratios, good, ("KW", "AE"), 0.55)).first()["release"]
    assert {r["name"] for r in metrics.gate(base, target, ratios, bad, ("KW", "AE"), 0.55).where("NOT ok").collect()} == {"ratios"}
    assert not metrics.released(metrics.gate(base, target, ratios, good, ("KW", "AE", "BH"), 0.55, strict=True)).first()["release"]


def test_calibration_improves_a_shifted_classifier(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        y = k % 3
        a = rng.normal(size=3) * 0.4
        a[y] += 1.5
        a[0] += 1.0
        rows.append((y, (np.exp(a) / np.exp(a).sum()).tolist()))
    df = spark.createDataFrame(rows, "truth int, probs array<double>").coalesce(2)
    start = calibration.scored(df, [[0.0] * 3], 3).first()["accuracy"]
    bias, score = calibration.descend(df, 3, [0.5], [0, 1, 2], {"accuracy": 1.0}, passes=1)
    assert score > start and bias[0] < 0


def wav(seconds, rate=16_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.sin(np.arange(int(seconds * rate)) / 20) * 20_000).astype("<i2").repeat(channels).tobytes())
    return out.getvalue()


def test_audio(spark):
    mono, stereo = audio.decode_wav(wav(0.5)), audio.decode_wav(wav(0.5, channels=2))
    assert len(mono) == 8000 and np.allclose(mono, stereo)
    with pytest.raises(ValueError):
        audio.decode_wav(wav(0.1, rate=8000))
    df = spark.createDataFrame([(bytearray(wav(0.25)),)], "b binary")
    assert len(df.select(audio.samples(F.col("b"))).first()[0]) == 4000
    assert one(spark, audio.crop_starts(F.lit(100), 10, 3)) == [0, 45, 90]
    assert one(spark, audio.padded(F.array(F.lit(1.0)), F.lit(3))) == [1.0, 0.0, 0.0]
    assert one(spark, audio.centre_crop(F.array(*map(F.lit, (1, 2, 3, 4, 5))), 3)) == [2, 3, 4]


def test_archives_and_layouts(spark, tmp_path):
    good = tmp_path / "a.tar"
    with tarfile.open(good, "w") as tar:
        for name, data in (("x.wav", b"12"), ("y.wav", b"3")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "b.tar").write_bytes(b"no archive")
    paths = [f"file:{good}", f"file:{tmp_path}/b.tar"]
    wanted = spark.createDataFrame([(paths[0], "x.wav", 1), (paths[0], "x.wav", 2), (paths[1], "x.wav", 3)], "tar_path string, member string, k int")
    assert sorted((r["k"], bytes(r["bytes"])) for r in readers.archive_members(spark, paths, wanted).collect()) == [(1, b"12"), (2, b"12")]
    for snapshot in ("s1", "s2"):
        spark.range(3).write.parquet(f"{tmp_path}/set/snapshots/{snapshot}/data/train-0.parquet")
    assert readers.dataset_dir(spark, f"file:{tmp_path}/set").endswith("s2/data")
    (tmp_path / "set/refs").mkdir()
    (tmp_path / "set/refs/main").write_text("s1\n")
    assert readers.dataset(spark, f"file:{tmp_path}/set", "train").count() == 3
    assert readers.dataset_dir(spark, f"file:{tmp_path}/set").endswith("s1/data")
    with pytest.raises(FileNotFoundError):
        readers.split_files(spark, f"file:{tmp_path}/set", "test")


def test_markers_gate_what_is_read(spark, tmp_path):
    import zstandard

    state = tmp_path / "state"
    state.mkdir()
    head = ",".join(("tar_path", "member", *readers.REQUIRED_PREDICTIONS))
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(f"{head}\nt{k},m,1,MA,MA,0.9,EG,SA,0.5,,3.0\nt{k},short,1\n")
        if k < 2:
            (state / f"shard_{k}.done").write_text(json.dumps({"output_csv": f"{tmp_path}/p{k}.csv", "csv_rows": 2}))
    rows = readers.completed_predictions(spark, str(tmp_path))
    assert rows.count() == 4 and rows.where("member = 'short'").first()["margin"] == ""
    assert sorted(r["shard"] for r in readers.markers(spark, str(state)).collect()) == [0, 1]
    q = markers.sync(spark, str(state), f"{tmp_path}/table", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/table").count() == 4
    (tmp_path / "m.jsonl.zst").write_bytes(zstandard.compress(b'{"a": 1}\n\n{"a": 2}\n'))
    assert sorted(r["a"] for r in readers.manifest(spark, f"{tmp_path}/m.jsonl.zst").collect()) == [1, 2]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.prediction_csv(spark, [f"{tmp_path}/bad.csv"])


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("sample_id")).coalesce(1)
    found = sinks.sharded_csv(df, f"{tmp_path}/out", 10).orderBy("first_sample").collect()
    assert [(r["rows"], r["first_sample"], r["last_sample"]) for r in found] == [(10, 0, 9), (10, 10, 19), (5, 20, 24)]
    sinks.document(spark, f"{tmp_path}/d.json", {"b": 1, "a": "é"})
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": "é", "b": 1}
    with sinks.writer_lock(spark, f"{tmp_path}/out"), pytest.raises(RuntimeError):
        with sinks.writer_lock(spark, f"{tmp_path}/out"):
            pass
    assert "| 0 |" in sinks.markdown(df, "t", 2)


def test_upserts_and_islands(spark):
    rows = spark.createDataFrame([("t", "m", 1, 5), ("t", "m", 2, 6), ("t", "n", 1, 7)], "tar_path string, member string, shard int, v int")
    again = markers.merge(markers.merge(None, rows), rows)
    assert sorted((r["member"], r["v"]) for r in again.collect()) == [("m", 6), ("n", 7)]
    spans = tracker.islands(spark.createDataFrame([(x,) for x in (3, 5, 6, 7, 9, 9)], "x int"), "x")
    assert sorted(r["span"] for r in spans.collect()) == ["3", "5-7", "9"]


def test_bias_document():
    doc = json.dumps({"bias_by_id": {"0": 1}, "bias_by_code": {"b": 2}})
    assert readers.bias_vector(doc, ("A", "B")) == [1, 2]
    with pytest.raises(ValueError):
        readers.bias_vector('{"bias": [1]}', ("A", "B"))
