"""File scans and writers on temporary files, and the image layer on generated PNGs."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriset.functions import vectors
from veriset.operators import images, profile
from veriset.plans.report import control_report, metric_rows
from veriset.sources import files, sinks


def png(pixels: np.ndarray) -> bytes:
    """Minimal encoder for height x width x 3 bytes."""
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[r].astype(np.uint8).tobytes() for r in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, size=(24, 27, 3))
    pictures = {
        "train/b_class/one.PNG": base,
        "train/a_class/two.png": 255 - base,
        "val/b_class/copy.png": base,
        "val/a_class/flat.png": np.full((10, 10, 3), 77),
        "val/a_class/brighter.png": np.clip(base + 3, 0, 255),
    }
    for name, pixels in pictures.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(pixels))
    (root / "train/a_class/notes.txt").write_text("no image")
    return root, pictures


def test_labelled_tree_and_digests(spark, tree):
    root, pictures = tree
    found = images.content_digests(files.labelled_tree(spark, str(root))).collect()
    assert {r.relative_path for r in found} == set(pictures)
    assert {(r.class_name, r.class_index) for r in found} == {("a_class", 0), ("b_class", 1)}
    one = next(r for r in found if r.relative_path == "train/b_class/one.PNG")
    assert one.digest == hashlib.sha256(png(pictures["train/b_class/one.PNG"])).hexdigest()
    folders = files.selected_folders(spark, str(root), ["a_class"]).groupBy("folder").count().collect()
    assert [(r.folder, r["count"]) for r in folders] == [("a_class", 3)]


def test_missing_files_never_read_contents(spark, tree):
    root, _ = tree
    listing = files.with_path_parts(files.binary_files(spark, str(root)), ("train", "val")).select("relative_path")
    manifest = spark.createDataFrame([("train/b_class/one.PNG",), ("train/b_class/gone.png",)], "relative_path string")
    missing = files.missing_files(manifest, listing)
    assert [r.relative_path for r in missing.collect()] == ["train/b_class/gone.png"]
    assert "content" not in missing._jdf.queryExecution().executedPlan().toString()


def test_image_hashes(spark, tree):
    root, pictures = tree
    pixels = files.image_pixels(spark, str(root))
    hashes = {r.path.split("/")[-1]: r.fp for r in images.dhashes(pixels).collect()}
    assert len(hashes) == 5 and hashes["one.PNG"] == hashes["copy.png"] and hashes["flat.png"] == 0
    close = bin((hashes["one.PNG"] ^ hashes["brighter.png"]) & (2**64 - 1)).count("1")
    far = bin((hashes["one.PNG"] ^ hashes["two.png"]) & (2**64 - 1)).count("1")
    assert close <= 4 < 40 < far


def test_grid_of_an_exact_size_image_is_its_grey_values(spark, tmp_path):
    grey = np.arange(72).reshape(8, 9) * 3
    (tmp_path / "g.png").write_bytes(png(np.repeat(grey[:, :, None], 3, axis=2)))
    row = images.grey_grids(files.image_pixels(spark, str(tmp_path))).first()
    assert row.grid == [float(v) for v in grey.ravel()]


def test_lanczos_weights_sum_to_one_and_keep_flat_images_flat():
    for size, target in ((256, 9), (100, 8), (5, 9)):
        weights = images.lanczos_weights(size, target)
        assert weights.shape == (target, size) and weights.sum(axis=1) == pytest.approx(np.ones(target))


def test_pixel_similarity(spark, tree):
    root, _ = tree
    pixels = images.standard_pixels(files.image_pixels(spark, str(root)), size=32)
    path = {r.path.split("/")[-1]: r.path for r in pixels.select("path").collect()}
    pairs = spark.createDataFrame(
        [(path["one.PNG"], path["copy.png"]), (path["one.PNG"], path["flat.png"]), (path["one.PNG"], path["brighter.png"])], "path_a string, path_b string"
    )
    found = {r.path_b.split("/")[-1]: r for r in images.pixel_similarity(pairs, pixels).collect()}
    assert found["copy.png"].rgb_mae == 0 and found["copy.png"].gray_pixel_correlation == pytest.approx(1)
    assert found["flat.png"].gray_pixel_correlation == 0.0
    assert 0 < found["brighter.png"].rgb_mae < 0.03


def test_manifest_csv_keeps_text_and_normalises(spark, tmp_path):
    header = "split,official_split,relative_path,source_partition,class_index,class_name,official_path,leaf_id,sha256\n"
    (tmp_path / "m.csv").write_text(header + 'train,train,train\\A\\x.jpg,train,0,NA,o,,abc\ntest,test,t/A/y.jpg,val,0,A,o,"",def\n')
    rows = files.manifest_csv(spark, str(tmp_path / "m.csv")).collect()
    assert [r.relative_path for r in rows] == ["train/A/x.jpg", "t/A/y.jpg"]
    assert [r.leaf_id for r in rows] == [None, None] and rows[0].class_name == "NA"


def test_csv_round_trip_of_arrays_and_empty_tables(spark, tmp_path):
    table = spark.createDataFrame([("d", ["train", "test"], 2)], "digest string, splits array<string>, count bigint")
    sinks.write_csv(table, str(tmp_path / "a"))
    assert spark.read.csv(str(tmp_path / "a"), header=True).first().splits == "train|test"
    pairs = spark.createDataFrame([(2, "c", 1, 2), (1, "c", 5, 6)], "distance int, class string, first_id_a int, first_id_b int")
    sinks.write_csv(pairs.coalesce(1), str(tmp_path / "o"), order_by=sinks.REPORT_ORDER["near_pairs"])
    assert [r.distance for r in spark.read.csv(str(tmp_path / "o"), header=True).collect()] == ["1", "2"]
    sinks.write_table(table.filter("count > 5"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).columns == table.columns


def test_histories_and_documents(spark, tmp_path):
    fields = files.HISTORY_SCHEMA.split(", ")
    header = ",".join(f.split(" ")[0] for f in fields)
    for run in ("r1", "r2"):
        (tmp_path / f"{run}_history.csv").write_text(header + "\n1" + ",0.5" * (len(fields) - 1) + "\n")
    table = files.named_csv(spark, [str(p) for p in sorted(tmp_path.glob("*_history.csv"))])
    assert sorted(r.run_name for r in table.collect()) == ["r1", "r2"]
    (tmp_path / "s1.json").write_text(json.dumps({"run_name": "r1", "errors": 3, "test_accuracy": 0.5}, indent=2))
    (tmp_path / "s2.json").write_text(json.dumps({"run_name": "r2", "test_errors": 4, "other": {"x": 1}}))
    found = files.json_documents(spark, [str(tmp_path / "s1.json"), str(tmp_path / "s2.json")])
    assert {(r.run_name, r.errors, r.test_errors) for r in found.collect()} == {("r1", 3, None), ("r2", None, 4)}


def test_lists_and_maps(spark, tmp_path):
    (tmp_path / "list.txt").write_text("  a/b.jpg \n\n\t\nc/d.jpg\n")
    assert [r.line for r in files.split_list(spark, str(tmp_path / "list.txt")).collect()] == ["a/b.jpg", "c/d.jpg"]
    (tmp_path / "map.json").write_text(json.dumps({"x 1": "one", "y": ["a", "b"], "z": [], "w": ""}, indent=1))
    found = {r.identifier: r.suggestions for r in files.metadata_map(spark, str(tmp_path / "map.json")).collect()}
    assert found == {"x 1": ["one"], "y": ["a", "b"], "z": [], "w": None}


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.stage(spark, str(tmp_path / "stage"), build).count() == 3
    assert len(calls) == 1


def test_summary_matrix_and_probability_writers(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 3), (1, 0, 1)], "true_index int, predicted_index int, count bigint")
    sinks.write_matrix(cells, ["cat", "dog"], str(tmp_path / "m"))
    rows = spark.read.csv(str(tmp_path / "m"), header=True).collect()
    assert sorted((r.true_class, r.cat, r.dog) for r in rows) == [("cat", "3", "0"), ("dog", "1", "0")]
    sinks.write_summary(spark.createDataFrame([(1, True)], "n int, passed boolean"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().passed is True
    scored = spark.createDataFrame([("m", 1, 0, [1.0])], "model string, id int, target int, probs array<double>")
    sinks.write_probabilities(scored, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("model = 'm'").first().probs == [1.0]


def test_completeness_and_report(spark):
    listed = spark.createDataFrame([("a",), ("a",), ("c",)], "folder string")
    expected = spark.createDataFrame([("a", 2), ("b", 1)], "folder string, expected bigint")
    found = {r.folder: (r.expected, r.actual, r.complete) for r in profile.folder_completeness(listed, expected).collect()}
    assert found == {"a": (2, 2, True), "b": (1, 0, False), "c": (0, 1, False)}
    sections = spark.createDataFrame([("x",), ("y",)], "section string")
    rows = metric_rows("x", spark.createDataFrame([(1.5,)], "v double"), ["v"])
    assert {(r.section, r.status, r.value) for r in control_report(sections, [rows]).collect()} == {("x", "DONE", 1.5), ("y", "PENDING", None)}


def test_band_values_of_hashes(spark):
    bands = spark.range(1).select(vectors.hash_bands(F.lit(-1), 9).alias("b")).first().b
    assert [b.value for b in bands] == [2**b.size - 1 for b in bands] and sum(b.size for b in bands) == 64


def test_a_stage_follows_its_inputs_and_parameters(spark, tmp_path):
    source, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).groupBy().count()

    def run(parameters=None):
        return sinks.stage(spark, str(tmp_path / "stage"), build, [source, str(tmp_path / "absent")], parameters).first()[0]

    spark.range(5).write.parquet(source)
    assert run() == 5 and run() == 5 and len(built) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert run() == 7 and run() == 7 and len(built) == 2
    assert run({"seed": 1}) == 7 and len(built) == 3
    sinks.prune(spark, str(tmp_path / "stage"))
    assert run({"seed": 1}) == 7 and len(built) == 3


def test_a_set_is_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "set")
    assert sinks.published(spark, path) == {}
    sinks.publish(spark, {"manifest": spark.range(3), "log": spark.range(1)}, path)
    before = sinks.published(spark, path)
    reader = spark.read.parquet(before["manifest"])
    broken = spark.range(4).select(F.raise_error(F.lit("no log")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no log"):
        sinks.publish(spark, {"manifest": spark.range(9), "log": broken}, path)
    assert sinks.published(spark, path) == before and reader.count() == 3
    sinks.publish(spark, {"manifest": spark.range(9), "log": spark.range(2)}, path)
    now = sinks.published(spark, path)
    assert (spark.read.parquet(now["manifest"]).count(), spark.read.parquet(now["log"]).count()) == (9, 2)
    assert reader.count() == 3
    sinks.prune(spark, path)
    assert spark.read.parquet(sinks.published(spark, path)["manifest"]).count() == 9
    assert len([p for p in (tmp_path / "set").iterdir() if not p.name.startswith(".")]) == 2


def test_json_ranges_cut_anywhere(spark, tmp_path):
    """Every cut of a small object, with texts that look like structure, gives the same entries."""
    from veriset.sources import jsonobject

    wanted = {'a"],{': ["x\\", '"', "},"], "b": "plain, \\\" text", "": None, "n": 3, "é\u2028": ["é" * 5], "d": {"k": ["v", {"w": "]"}]}, "last": []}
    for text in (json.dumps(wanted), json.dumps(wanted, indent=2, ensure_ascii=False) + "\n"):
        path = tmp_path / "object.json"
        path.write_text(text, encoding="utf-8")
        expected = sorted((k, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in wanted.items())
        for size in range(1, 40):
            first = jsonobject._Reader({"path": str(path), "size": str(size)})
            parts = first.partitions()
            effects = [{mode: (end, delta) for _, _, mode, end, delta in first.read(p)} for p in parts]
            state, states = (jsonobject.OUTSIDE, 0), []
            for effect in effects:
                states.append(state)
                state = (effect[state[0]][0], state[1] + effect[state[0]][1])
            second = jsonobject._Reader({"path": str(path), "size": str(size), "states": json.dumps(states)})
            assert sorted((e for p in second.partitions() for e in second.read(p)), key=lambda e: e[0]) == expected, size
    found = {r.identifier: r.value for r in jsonobject.json_object(spark, str(path), 7).collect()}
    assert found == dict(expected)
    (tmp_path / "cut.json").write_text(json.dumps(wanted)[:-9])
    with pytest.raises(Exception, match="ends inside an entry"):
        jsonobject.json_object(spark, str(tmp_path / "cut.json"), 16).collect()
    (tmp_path / "empty.json").write_text(" {} ")
    assert jsonobject.json_object(spark, str(tmp_path / "empty.json"), 2).collect() == []


def test_a_table_is_published_only_if_its_rows_keep_the_contracts(spark, tmp_path):
    from veriset.operators.checks import ContractError

    path = str(tmp_path / "set")
    contracts = {"small": F.col("id") > 5, "even": F.col("id") % 2 == 1}
    good = spark.range(0, 6, 2)
    assert {tuple(r) for r in sinks.publish_checked(spark, good, contracts, path).collect()} == {("small", 0, True), ("even", 0, True)}
    before = sinks.published(spark, path)
    with pytest.raises(ContractError, match="even: 5 violations"):
        sinks.publish_checked(spark, spark.range(10).repartition(3), contracts, path)
    assert sinks.published(spark, path) == before and spark.read.parquet(before["manifest"]).count() == 3
