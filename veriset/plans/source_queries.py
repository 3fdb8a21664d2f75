"""Round trips through the sources and sinks, and the data contracts, over the supplied tables.

Each query writes what it derives from a table in an exchange format below the checkpoint folder and scans it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from veriset.functions import flags
from veriset.functions.names import hash60
from veriset.operators import checks, cleanup, components, images, profile, splits
from veriset.plans import derived
from veriset.plans.catalog import query
from veriset.plans.sql_parts import DOCS, EMB, h60, probabilities, split_case
from veriset.session import own_folder
from veriset.sources import files, sinks


def _fresh(spark: SparkSession) -> str:
    return f"{own_folder(spark)}/exchange-{uuid.uuid4().hex}"


def _tree(spark: SparkSession, folder: str) -> str:
    """Texts as files, one per (split, language): <root>/partition=<split>/class=<language>/<file>.txt."""
    root = _fresh(spark)
    docs = derived.documents(spark, folder).select(F.col("split").alias("partition"), "class", F.md5("text").alias("value"))
    docs.repartition("partition", "class").write.partitionBy("partition", "class").text(root)
    return root


_PARTITIONS = tuple(f"partition={s}" for s in ("train", "validation", "test"))


@query(
    "labelled_tree",
    f"""WITH {DOCS}, c AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS class_index FROM (SELECT DISTINCT class FROM docs))
SELECT 'partition=' || split AS "partition", 'class=' || class AS class_name, class_index, count(*) * 33 AS length FROM docs JOIN c USING (class) GROUP BY ALL""",
)
def labelled_tree(spark, folder):
    tree = files.labelled_tree(spark, _tree(spark, folder), _PARTITIONS, (".txt",))
    return tree.groupBy("partition", "class_name", "class_index").agg(F.sum("length").alias("length"))


@query("selected_folders", f"WITH {DOCS} SELECT 'class=' || class AS folder, count(*) * 33 AS length FROM docs WHERE class IN ('de', 'fr') GROUP BY class")
def selected_folders(spark, folder):
    chosen = files.selected_folders(spark, _tree(spark, folder), ["class=de", "class=fr"], (".txt",))
    return chosen.groupBy("folder").agg(F.sum("length").alias("length"))


def _manifest(docs: DataFrame) -> DataFrame:
    index = F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("class")).cast("int") - 1
    return docs.select(
        "split",
        F.when(F.col("split") == "test", "test").otherwise("train").alias("official_split"),
        F.concat_ws("\\", "split", "class", F.concat("id", F.lit(".txt"))).alias("relative_path"),
        F.col("source").alias("source_partition"),
        index.alias("class_index"),
        F.col("class").alias("class_name"),
        F.concat_ws("/", F.lit("raw"), "class", F.col("id").cast("string")).alias("official_path"),
        F.col("object").alias("leaf_id"),
        F.col("digest").alias("sha256"),
    )


_MANIFEST_SQL = f"""WITH {DOCS}, manifest AS (
SELECT split, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS official_split, split || '/' || class || '/' || id || '.txt' AS relative_path,
  source AS source_partition, list_position(['de', 'en', 'es', 'fr'], class) - 1 AS class_index, class AS class_name, 'raw/' || class || '/' || id AS official_path,
  object AS leaf_id, digest AS sha256 FROM docs)"""


def _written_manifest(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark)
    sinks.write_csv(_manifest(derived.documents(spark, folder)), path)
    return files.manifest_csv(spark, path)


@query("manifest_csv", f"{_MANIFEST_SQL} SELECT * REPLACE (class_index::BIGINT AS class_index) FROM manifest")
def manifest_csv(spark, folder):
    return _written_manifest(spark, folder)


@query("required_columns", f"{_MANIFEST_SQL} SELECT split, count(*) AS records, count(DISTINCT relative_path) AS files FROM manifest GROUP BY split")
def required_columns(spark, folder):
    manifest = checks.require_columns(_written_manifest(spark, folder), {"split", "relative_path", "class_index", "sha256"}, "manifest")
    return manifest.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("relative_path").alias("files"))


@query("missing_files", f"{_MANIFEST_SQL} SELECT relative_path, split FROM manifest WHERE {h60("'lost:' || relative_path")} % 40 = 0")
def missing_files(spark, folder):
    manifest = _written_manifest(spark, folder)
    there = manifest.where(hash60(F.lit("lost:"), F.col("relative_path")) % 40 != 0)
    return files.missing_files(manifest, there).select("relative_path", "split")


@query(
    "named_histories",
    "SELECT 'run' || (user_id % 10) AS run_name, count(*) AS epochs, round(sum(value), 4) AS train_loss FROM events GROUP BY 1",
)
def named_histories(spark, folder):
    """Ten history files, named after their runs as an exporter names them."""
    root = _fresh(spark)
    events = derived.table(spark, folder, "events").select(
        F.concat(F.lit("run"), F.col("user_id") % 10).alias("run"), F.col("event_id").cast("int").alias("epoch"), F.lit(0.001).alias("learning_rate"), F.col("value").alias("train_loss")
    )
    columns = [c.strip().split(" ")[0] for c in files.HISTORY_SCHEMA.split(",")]
    filled = events.select("run", *[F.col(c) if c in events.columns else F.lit(None).cast("double").alias(c) for c in columns])
    filled.repartition("run").write.partitionBy("run").csv(root, header=True)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = []
    for listed in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run=*/part-*")):
        run = listed.getPath().getParent().getName().removeprefix("run=")
        paths.append(f"{root}/{run}_history.csv")
        store.rename(listed.getPath(), spark._jvm.org.apache.hadoop.fs.Path(paths[-1]))
    table = files.named_csv(spark, paths)
    return table.groupBy("run_name").agg(F.count("*").alias("epochs"), F.round(F.sum("train_loss"), 4).alias("train_loss"))


def _run_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per brand, as a training job leaves one per run; some carry the protocol under its other name."""
    other = hash60(F.lit("protocol:"), F.col("p_brand")) % 2 == 0
    runs = derived.table(spark, folder, "part").groupBy("p_brand").agg(F.count("*").alias("test_examples"), F.count_if(F.col("p_size") > 40).alias("errors"))
    named = runs.select(
        F.col("p_brand").alias("run_name"), "test_examples", "errors",
        F.when(other, "strict").alias("data_protocol"), F.when(~other, "strict").alias("evaluation_protocol"), F.lit(False).alias("test_used_during_training"),
        F.col("p_brand").alias("file"),
    )
    root = _fresh(spark)
    named.repartition("file").write.partitionBy("file").json(root)
    return files.json_documents(spark, f"{root}/*/*.json")


_RUNS_SQL = f"""WITH runs AS (SELECT p_brand AS run_name, count(*) AS test_examples, count(*) FILTER (WHERE p_size > 40) AS errors,
  {h60("'protocol:' || p_brand")} % 2 = 0 AS other FROM part GROUP BY p_brand)"""


@query("json_documents", f"{_RUNS_SQL} SELECT run_name, test_examples, errors, CASE WHEN other THEN 'strict' END AS data_protocol FROM runs")
def json_documents(spark, folder):
    return _run_documents(spark, folder).select("run_name", "test_examples", "errors", "data_protocol")


@query("protocol_fallback", f"{_RUNS_SQL} SELECT run_name, 'strict' AS protocol FROM runs")
def protocol_fallback(spark, folder):
    found = _run_documents(spark, folder)
    return found.select("run_name", flags.fallback_protocol(F.col("data_protocol"), F.col("evaluation_protocol")).alias("protocol"))


@query(
    "run_metadata_contract",
    f"""{_RUNS_SQL}, most AS (SELECT max(test_examples) AS n FROM runs) SELECT 'run_metadata' AS "check", count(*) FILTER (WHERE test_examples <> n) AS violations,
count(*) FILTER (WHERE test_examples <> n) = 0 AS passed FROM runs, most""",
)
def run_metadata_contract(spark, folder):
    runs = _run_documents(spark, folder).withColumn("protocol", flags.fallback_protocol(F.col("data_protocol"), F.col("evaluation_protocol"))).withColumn("config_run_name", F.col("run_name"))
    most = runs.agg(F.max("test_examples")).first()[0] or 0
    return checks.check("run_metadata", checks.run_metadata_violations(runs, "strict", most))


@query("split_list", "SELECT trim(regexp_replace(url, '[?#].*$', '')) AS line, count(*) AS n FROM pages GROUP BY 1")
def split_list(spark, folder):
    root = _fresh(spark)
    lines = derived.table(spark, folder, "pages").select(F.explode(F.array(F.concat(F.lit("  "), F.regexp_replace("url", "[?#].*$", ""), F.lit("\t")), F.lit("   "))).alias("value"))
    lines.write.text(root)
    return files.split_list(spark, root).groupBy("line").agg(F.count("*").alias("n"))


_MAP_SQL = f"""WITH {DOCS}, map AS (SELECT 'obj ' || (id // 5) AS identifier, list(DISTINCT object ORDER BY object) AS suggestions FROM docs WHERE object IS NOT NULL GROUP BY 1)
SELECT identifier, array_to_string(suggestions, '|') AS suggestions FROM map"""


@query("metadata_map", _MAP_SQL)
def metadata_map(spark, folder):
    """The map as one JSON object in one file, read in ranges of 4 KB that cut entries anywhere."""
    docs = derived.documents(spark, folder).where("object is not null")
    grouped = docs.groupBy(F.concat(F.lit("obj "), F.expr("id div 5")).alias("identifier")).agg(F.array_sort(F.collect_set("object")).alias("suggestions"))
    entry = F.concat(F.lit(", "), F.substring(F.to_json(F.create_map("identifier", "suggestions")), 2, 1 << 30))
    lines = grouped.select(F.lit(1).alias("place"), entry.alias("value"))
    lines = lines.select("place", F.substring("value", F.lit(1), F.length("value") - 1).alias("value"))
    ends = spark.createDataFrame([(0, '{"": null'), (2, "}")], "place int, value string")
    path = _fresh(spark)
    # one file is what is tested here; its lines pass, none is gathered
    lines.unionByName(ends).orderBy("place").coalesce(1).select("value").write.text(path)
    return files.metadata_map(spark, path, 4096).where("identifier <> ''").select("identifier", "suggestions")


@query("metadata_lines", _MAP_SQL)
def metadata_lines(spark, folder):
    docs = derived.documents(spark, folder).where("object is not null")
    root = _fresh(spark)
    docs.groupBy(F.concat(F.lit("obj "), F.expr("id div 5")).alias("identifier")).agg(F.array_sort(F.collect_set("object")).alias("suggestions")).write.json(root)
    return files.metadata_lines(spark, root)


@query("csv_and_table_sink", f"WITH {DOCS} SELECT class, split, count(*) AS records, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM docs GROUP BY class, split")
def csv_and_table_sink(spark, folder):
    kinds = derived.documents(spark, folder).groupBy("class", "split").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("source")).alias("sources"))
    table, text = _fresh(spark), _fresh(spark)
    sinks.write_table(kinds, table, partition_by=["split"])
    sinks.write_csv(spark.read.parquet(table), text)
    return spark.read.schema("class string, records bigint, sources string, split string").csv(text, header=True)


@query("summary_sink", f"WITH {DOCS} SELECT count(*) AS records, count(object) AS mapped, count(DISTINCT digest) AS contents FROM docs")
def summary_sink(spark, folder):
    path = _fresh(spark)
    sinks.write_summary(derived.documents(spark, folder).agg(F.count("*").alias("records"), F.count("object").alias("mapped"), F.count_distinct("digest").alias("contents")), path)
    return spark.read.schema("records bigint, mapped bigint, contents bigint").json(path)


@query(
    "probability_sink",
    f"""WITH {EMB}, {probabilities('a')} SELECT 'a' AS model, target::BIGINT AS target, count(DISTINCT id) AS records,
  round(avg(p) FILTER (WHERE k = target), 6) AS mean_true, round(sum(p * p) / count(DISTINCT id), 6) AS mean_square FROM p_a GROUP BY target""",
)
def probability_sink(spark, folder):
    path = _fresh(spark)
    sinks.write_probabilities(derived.scored(spark, folder, "a").withColumn("model", F.lit("a")), path)
    squares = F.aggregate("probs", F.lit(0.0), lambda acc, p: acc + p * p)
    return spark.read.parquet(path).groupBy("model", "target").agg(F.count("*").alias("records"), F.avg(F.get("probs", F.col("target"))).alias("mean_true"), F.avg(squares).alias("mean_square"))


@query("stage_reuse", f"WITH {DOCS} SELECT split, count(*) AS records FROM docs GROUP BY split")
def stage_reuse(spark, folder):
    path = _fresh(spark)
    sinks.stage(spark, path, lambda: profile.split_counts(derived.documents(spark, folder)))
    # The second call finds the first one's result and must not build another.
    return sinks.stage(spark, path, lambda: spark.range(1).select(F.raise_error(F.lit("built twice"))))


@query("stage_freshness", f"WITH {DOCS} SELECT split, count(*) AS records FROM docs GROUP BY split")
def stage_freshness(spark, folder):
    """A stage over a folder that grows after the first run: the second one covers what was added."""
    source, path = _fresh(spark), _fresh(spark)
    docs = derived.documents(spark, folder).select("id", "split")
    for part in (F.col("split") == "train", F.col("split") != "train"):
        docs.filter(part).write.mode("append").parquet(source)
        found = sinks.stage(spark, path, lambda: profile.split_counts(spark.read.parquet(source)), [source])
    return found


@query(
    "published_set",
    f"""WITH {DOCS}, te AS (SELECT DISTINCT digest FROM docs WHERE split = 'test')
SELECT 'manifest' AS "table", count(*) AS "rows" FROM docs WHERE split = 'test' OR digest NOT IN (SELECT digest FROM te)
UNION ALL SELECT 'log', count(*) FROM docs WHERE split <> 'test' AND digest IN (SELECT digest FROM te)""",
)
def published_set(spark, folder):
    """A manifest and its log published together twice; the second set replaces the first one as a whole."""
    path = _fresh(spark)
    docs = derived.digests(spark, folder).select("id", "split", "digest")
    test = docs.filter("split = 'test'").select("digest").distinct()
    others = docs.filter("split <> 'test'")
    kept = docs.filter("split = 'test'").unionByName(others.join(test, "digest", "left_anti"))
    sinks.publish(spark, {"manifest": docs, "log": docs.limit(0)}, path)
    sinks.publish(spark, {"manifest": kept, "log": others.join(test, "digest", "left_semi")}, path)
    sinks.prune(spark, path)
    counts = [spark.read.parquet(where).agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, where in sinks.published(spark, path).items()]
    return counts[0].unionByName(counts[1])


@query("report_order", f"""WITH {DOCS} SELECT count(*) AS "rows", 0::BIGINT AS misplaced FROM docs""")
def report_order(spark, folder):
    """Rows of an exported manifest that stand before a smaller one: none, in whatever pieces the export was cut."""
    path = _fresh(spark)
    sinks.write_csv(derived.documents(spark, folder).select("split", "class", "id"), path, order_by=sinks.REPORT_ORDER["manifest"])
    table = spark.read.schema("split string, class string, id bigint").csv(path, header=True)
    # Ends of the files in name order, and neighbours within each file as the reader delivers them.
    key = F.struct("split", "class", "id")
    seen = table.select(F.col("_metadata.file_name").alias("file"), key.alias("key"), F.monotonically_increasing_id().alias("at"))
    by_file = seen.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    wrong = (F.col("low") != F.col("first")) | (F.col("high") != F.col("last"))
    return by_file.agg(F.sum("n").alias("rows"), F.count_if(wrong).alias("misplaced"))


# --- contracts -----------------------------------------------------------------------------


@query(
    "manifest_row_contracts",
    f"""WITH {DOCS}, c AS (SELECT count(*) FILTER (WHERE split NOT IN ('train', 'validation', 'test')) AS a, count(*) FILTER (WHERE digest IS NULL) AS b,
  count(*) FILTER (WHERE class NOT IN ('de', 'en', 'es', 'fr')) AS c, count(*) FILTER (WHERE object IS NULL) AS d FROM docs)
SELECT "check", n AS violations, n = 0 AS passed FROM (SELECT 'split_is_known' AS "check", a AS n FROM c UNION ALL SELECT 'digest_is_there', b FROM c
  UNION ALL SELECT 'class_is_known', c FROM c UNION ALL SELECT 'object_is_mapped', d FROM c)""",
)
def manifest_row_contracts(spark, folder):
    """Row contracts of the manifest, counted in the pass that writes it."""
    contracts = {
        "split_is_known": ~F.col("split").isin("train", "validation", "test"),
        "digest_is_there": F.col("digest").isNull(),
        "class_is_known": ~F.col("class").isin("de", "en", "es", "fr"),
        "object_is_mapped": F.col("object").isNull(),
    }
    manifest = derived.documents(spark, folder).drop("text")
    watched, observation = checks.observed(manifest, contracts)
    sinks.write_table(watched, _fresh(spark))
    return checks.observed_checks(manifest, observation)


@query("expected_cardinality", """SELECT 'one_row_per_label' AS "check", abs(count(*) - count(DISTINCT doc_id)) AS violations, count(*) = count(DISTINCT doc_id) AS passed FROM labels""")
def expected_cardinality(spark, folder):
    labels = derived.table(spark, folder, "labels")
    return checks.check_count("one_row_per_label", labels, labels.agg(F.count_distinct("doc_id")).first()[0])


@query(
    "group_minimum",
    f"""WITH {DOCS}, g AS (SELECT source || '/' || class AS class, count(DISTINCT coalesce('leaf::' || object, 'unmapped_hash::' || digest)) AS "groups" FROM docs GROUP BY 1)
SELECT * FROM g WHERE "groups" < 30""",
)
def group_minimum(spark, folder):
    from veriset.functions.names import group_key

    docs = derived.documents(spark, folder).withColumn("class", F.concat_ws("/", "source", "class")).withColumn("group", group_key(F.col("object"), F.col("digest")))
    return splits.too_few_groups(splits.group_sizes(docs), 30)


@query(
    "misplaced_pairs",
    f"""WITH {DOCS}, p AS (SELECT id AS id_a, id + 7 AS id_b FROM docs)
SELECT id_a, id_b FROM p LEFT JOIN docs a ON a.id = id_a LEFT JOIN docs b ON b.id = id_b WHERE a.split IS NULL OR b.split IS NULL OR a.split = b.split""",
)
def misplaced_pairs(spark, folder):
    docs = derived.digests(spark, folder)
    pairs = docs.select(F.col("id").alias("id_a"), (F.col("id") + 7).alias("id_b"))
    return cleanup.misplaced_pairs(cleanup.located_pairs(pairs, docs)).select("id_a", "id_b")


@query(
    "manifest_contracts",
    f"""WITH {DOCS}, n AS (SELECT count(DISTINCT source) AS n FROM docs),
gaps AS (SELECT count(*) AS v FROM (SELECT DISTINCT substr(source, 4)::INTEGER AS i FROM docs), n WHERE i < 0 OR i >= n),
claimed AS (SELECT split, count(*) AS n FROM docs WHERE {h60("'claim:' || id")} % 97 <> 0 GROUP BY split),
actual AS (SELECT split, count(*) AS n FROM docs GROUP BY split),
wrong AS (SELECT count(*) AS v FROM claimed c FULL JOIN actual a USING (split) WHERE c.n IS DISTINCT FROM a.n)
SELECT 'class_indices' AS "check", v AS violations, v = 0 AS passed FROM gaps UNION ALL SELECT 'summary_counts', v, v = 0 FROM wrong
UNION ALL SELECT 'zero_fields', CASE WHEN count(object) = count(*) THEN 0 ELSE 1 END, count(object) = count(*) FROM docs""",
)
def manifest_contracts(spark, folder):
    docs = derived.documents(spark, folder).drop("text")
    classes = docs.select(F.substring("source", 4, 9).cast("int").alias("class_index"))
    claimed = docs.where(hash60(F.lit("claim:"), F.col("id")) % 97 != 0).groupBy("split").agg(F.count("*").alias("records"))
    unmapped = docs.agg(F.count_if(F.col("object").isNull()).alias("unmapped"))
    return checks.all_checks(
        [
            checks.check("class_indices", checks.index_gaps(classes)),
            checks.check("summary_counts", checks.summary_mismatches(docs, claimed)),
            checks.check("zero_fields", checks.nonzero_fields(unmapped, ["unmapped"])),
        ]
    )


@query(
    "mixed_components",
    f"""WITH {DOCS} SELECT min(id) AS component, count(*) AS size, count(DISTINCT source) AS classes, min(source) AS class FROM docs GROUP BY digest HAVING count(DISTINCT source) > 1""",
)
def mixed_components(spark, folder):
    docs = derived.digests(spark, folder).withColumn("class", F.col("source")).withColumn("object", F.lit(None).cast("string")).withColumn("fp", F.lit(None).cast("bigint"))
    members = components.record_components(docs, near_edges=False)
    return components.mixed_components(components.component_table(members))


# --- images --------------------------------------------------------------------------------


def _pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a grey picture of 8 x 8 pixels, in the columns of Spark's image source."""
    level = lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor(x.cast("double") * 256.0 + 128.0), F.lit(0)), F.lit(255)).cast("int")), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", level), "")).cast(BinaryType())
    image = F.struct(F.concat(F.lit("v"), F.col("id")).alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    return derived.embeddings(spark, folder).select(image.alias("image"))


_LEVELS = f"""WITH {EMB}, px AS (SELECT 'v' || id AS path, id, list_transform(embedding, lambda x: least(greatest(floor(x * 256.0 + 128.0), 0.0), 255.0)) AS p FROM emb)"""


@query(
    "picture_pixels",
    f"""{_LEVELS} SELECT path, round(list_avg(p) / 255.0, 6) AS mean_grey, round(list_max(p) / 255.0, 6) AS max_grey FROM px""",
)
def picture_pixels(spark, folder):
    """Pictures at their own size, so that resampling changes nothing and SQL can follow."""
    px = images.standard_pixels(_pictures(spark, folder), size=8)
    mean = F.aggregate("grey", F.lit(0.0), lambda acc, x: acc + x) / F.size("grey")
    return px.select("path", mean.alias("mean_grey"), F.array_max("grey").alias("max_grey"))


@query(
    "picture_similarity",
    f"""{_LEVELS}, two AS (SELECT a.path AS path_a, b.path AS path_b, a.p AS pa, b.p AS pb FROM px a JOIN px b ON b.id = a.id + 1),
m AS (SELECT *, 64 * list_inner_product(pa, pa) - list_sum(pa) * list_sum(pa) AS va, 64 * list_inner_product(pb, pb) - list_sum(pb) * list_sum(pb) AS vb,
  64 * list_inner_product(pa, pb) - list_sum(pa) * list_sum(pb) AS vab FROM two)
SELECT path_a, path_b, round(list_sum(list_transform(range(1, 65), lambda i: abs(pa[i] - pb[i]))) / 64 / 255.0, 6) AS rgb_mae,
  round(CASE WHEN va <= 0 OR vb <= 0 THEN 0.0 ELSE vab / (sqrt(va) * sqrt(vb)) END, 6) + 0.0 AS gray_pixel_correlation FROM m""",
)
def picture_similarity(spark, folder):
    ids = derived.embeddings(spark, folder).select("id")
    pairs = ids.join(ids.select((F.col("id") - 1).alias("id")), "id").select(F.concat(F.lit("v"), F.col("id")).alias("path_a"), F.concat(F.lit("v"), F.col("id") + 1).alias("path_b"))
    return images.pixel_similarity(pairs, images.paired_pixels(_pictures(spark, folder), pairs, size=8))


@query(
    "picture_hashes",
    f"""{_LEVELS},
taps AS (SELECT c, k, (c + 0.5::DOUBLE) * 8 / 9 AS centre FROM (SELECT unnest(range(9)) AS c) CROSS JOIN (SELECT unnest(range(8)) AS k)),
lobes AS (SELECT c, k, CASE WHEN abs(x) >= 3 THEN 0.0 ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) END AS l
  FROM (SELECT c, k, k - centre + 0.5 AS x FROM taps WHERE k >= greatest(trunc(centre - 2.5), 0) AND k < least(trunc(centre + 3.5), 8))),
w AS (SELECT c, k, l / sum(l) OVER (PARTITION BY c) AS w FROM lobes),
cells AS (SELECT path, r, c, least(greatest(floor(sum(w * p[r * 8 + k + 1]) + 0.5), 0), 255) AS g FROM px CROSS JOIN (SELECT unnest(range(8)) AS r) CROSS JOIN w GROUP BY path, r, c)
SELECT a.path, lower(to_hex(sum(CASE WHEN a.g > b.g THEN (1::HUGEINT << (8 * a.r + a.c)::INTEGER) ELSE 0 END)::UBIGINT)) AS fp
FROM cells a JOIN cells b ON b.path = a.path AND b.r = a.r AND b.c = a.c + 1 GROUP BY a.path""",
)
def picture_hashes(spark, folder):
    """Difference hashes of all pictures; of 8 x 8 pixels only the rows are resampled, which SQL can follow."""
    return images.dhashes(_pictures(spark, folder)).select("path", F.lower(F.hex("fp")).alias("fp"))
