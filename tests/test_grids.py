import hashlib
from collections import Counter

from veriset.plans import derived


def test_grids_of_tokens(spark):
    texts = ["", "a B\tb\nc", "É é x y", " ".join(f"t{i % 700}" for i in range(5000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    found = {r.id: r.g for r in rows.select("id", derived.token_grid("text").alias("g")).collect()}
    for i, text in enumerate(texts):
        cells = Counter(int(hashlib.md5(t).hexdigest()[:15], 16) % derived.GRID_CELLS for t in text.lower().encode().split())
        assert found[i] == [cells[c] for c in range(derived.GRID_CELLS)]


def test_cells_of_tokens_stay_few():
    cells = derived._TokenCells()
    for i in range(300_000):
        cells[b"%d" % i]
    assert len(cells) <= 131_072
