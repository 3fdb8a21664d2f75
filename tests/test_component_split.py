import random

import duckdb
import pytest

import __spark_entry__ as entry
from veriset.operators.checks import ContractError
from veriset.plans import audit, derived


def test_mixed_components_and_small_classes_are_dealt_as_in_the_sql(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(60)]
    rows = [(i * 5, "en" if i % 7 else "de", "web", texts[i % 60]) for i in range(90)]  # some texts in both languages
    rows += [(1000, "fr", "web", "un"), (1005, "fr", "web", "deux trois quatre")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ContractError):
        audit.component_split(derived.fingerprints(spark, str(tmp_path)))
    found = entry.queries()["component_split"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(f"SELECT id, class, component, split FROM ({entry.oracle_sql()['component_split']})").fetchall()
    assert len(wanted) == len(rows)
    assert sorted(tuple(r) for r in found.select("id", "class", "component", "split").collect()) == sorted(wanted)
