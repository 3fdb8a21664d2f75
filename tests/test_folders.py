"""From a generated tree of pictures and a metadata map to audit, manifest, quarantine and their summaries."""

import json

import numpy as np
from test_sources import png

from veriset.operators import links
from veriset.plans import audit, folders
from veriset.sources import files


def test_a_folder_goes_through_the_whole_audit(spark, tmp_path):
    rng = np.random.default_rng(4)
    base, other = rng.integers(0, 256, size=(24, 27, 3)), rng.integers(0, 256, size=(24, 27, 3))
    slight = np.clip(base + 2, 0, 255)
    pictures = {
        "train/a/one.png": base,
        "test/a/one copy.png": base,
        "train/a/slight.png": slight,
        "test/b/other.png": other,
        "train/b/x___leaf7 copy.png": 255 - other,
        "test/b/leaf7.png": rng.integers(0, 256, size=(24, 27, 3)),
        "train/a/far.png": rng.integers(0, 256, size=(24, 27, 3)),
        "train/b/more.png": rng.integers(0, 256, size=(24, 27, 3)),
    }
    for name, pixels in pictures.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(pixels))
    (tmp_path / "map.json").write_text(json.dumps({"leaf7": "b:::7", "one": ["a:::1"], "far": ["zz", "a:::2"]}))
    records = folders.audit_records(spark, str(tmp_path / "tree"), files.metadata_map(spark, str(tmp_path / "map.json")), {"train": "train", "test": "test"})
    rows = {r.id: r for r in records.collect()}
    assert set(rows) == set(pictures) and all(r.fp is not None for r in rows.values())
    assert rows["train/a/one.png"].digest == rows["test/a/one copy.png"].digest
    assert {k: r.object for k, r in rows.items() if r.object} == {
        "train/a/one.png": "a:::1", "train/b/x___leaf7 copy.png": "b:::7", "test/b/leaf7.png": "b:::7", "train/a/far.png": "a:::2",
    } | ({"test/a/one copy.png": rows["test/a/one copy.png"].object} if rows["test/a/one copy.png"].object else {})

    tables = audit.leakage_audit(records)
    summary = folders.audit_summary(records, tables).first()
    assert (summary.train_records, summary.test_records, summary.exact_groups, summary.exact_pairs, summary.status) == (5, 3, 1, 1, "FAIL")
    assert summary.near_pairs >= 2 and summary.objects_over_splits >= 1

    manifest, log = audit.leakage_safe_manifest(records, 0.3)
    line = folders.manifest_summary(manifest, log).first()
    assert line.removed_exact == 1 and line.removed_object == 1 and line.test_records == 3
    assert line.train_records + line.validation_records == 3

    nodes = links.near_node_pairs(records, 4)
    cleaned, _, contract = audit.quarantined_manifest(records)
    gone = folders.quarantine_summary(records, cleaned, nodes).first()
    assert gone.strict_pairs == nodes.agg({"pairs": "sum"}).first()[0] and gone.removed_train >= 2 and gone.removed_test == 0
    assert all(r.passed for r in contract.collect() if r.check != "class_in_every_split")
