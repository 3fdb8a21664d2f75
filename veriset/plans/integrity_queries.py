"""Queries of the leakage audit, the split builders and the data contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veriset.functions import names, vectors
from veriset.operators import checks, cleanup, components, links, neighbours, profile, review, splits
from veriset.plans import audit, derived
from veriset.plans.catalog import query
from veriset.plans.sql_parts import DOCS, EMB, FDOCS, h60, near
from veriset.session import materialise, own_folder
from veriset.sources import sinks

PRIORITY = "CASE {0} WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"


# --- distributions -------------------------------------------------------------------------


@query(
    "class_split_distribution",
    f"""WITH {DOCS}
SELECT class, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation,
       count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total FROM docs GROUP BY class""",
)
def class_split_distribution(spark, folder):
    return profile.class_split_distribution(derived.documents(spark, folder))


@query("split_counts", f"WITH {DOCS} SELECT split, count(*) AS records FROM docs GROUP BY split")
def split_counts(spark, folder):
    return profile.split_counts(derived.documents(spark, folder))


@query(
    "missing_class_splits",
    f"""WITH {DOCS}, fine AS (SELECT source || '/' || class AS class, split FROM docs)
SELECT c.class, s.split FROM (SELECT DISTINCT class FROM fine) c
CROSS JOIN (SELECT unnest(['train', 'validation', 'test']) AS split) s
WHERE NOT EXISTS (SELECT 1 FROM fine f WHERE f.class = c.class AND f.split = s.split)""",
)
def missing_class_splits(spark, folder):
    fine = derived.documents(spark, folder).withColumn("class", F.concat_ws("/", "source", "class"))
    return profile.missing_class_splits(fine)


@query(
    "folder_completeness",
    f"""WITH {DOCS}, want AS (SELECT source AS folder, count(*) AS expected FROM docs WHERE {h60("'lost:' || id")} % 50 <> 0 OR source < 'n' GROUP BY source),
have AS (SELECT source AS folder, count(*) AS actual FROM docs GROUP BY source)
SELECT coalesce(w.folder, h.folder) AS folder, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual,
       coalesce(expected, 0) = coalesce(actual, 0) AS complete
FROM want w FULL JOIN have h ON w.folder = h.folder""",
)
def folder_completeness(spark, folder):
    docs = derived.documents(spark, folder)
    listed = docs.filter((names.hash60(F.lit("lost:"), F.col("id")) % 50 != 0) | (F.col("source") < "n"))
    expected = listed.groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("expected"))
    return profile.folder_completeness(docs.withColumnRenamed("source", "folder"), expected)


# --- exact duplicates ----------------------------------------------------------------------


def _groups_sql(key: str) -> str:
    return f"""WITH {DOCS}
SELECT {key}, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(*) AS records, string_agg(DISTINCT class, '|' ORDER BY class) AS classes
FROM docs WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(DISTINCT split) > 1"""


def _members_sql(key: str) -> str:
    return f"""WITH {DOCS} SELECT d.{key}, d.split, d.id, d.class FROM docs d
WHERE EXISTS (SELECT 1 FROM docs o WHERE o.{key} = d.{key} AND o.split <> d.split)"""


@query("exact_groups", _groups_sql("digest"))
def exact_groups(spark, folder):
    return links.cross_split_groups(derived.documents(spark, folder), "digest")


@query("exact_group_members", _members_sql("digest"))
def exact_group_members(spark, folder):
    docs = derived.digests(spark, folder)
    return links.group_members(docs, links.cross_split_groups(docs, "digest"), "digest")


@query("leaf_groups", _groups_sql("object"))
def leaf_groups(spark, folder):
    return links.cross_split_groups(derived.documents(spark, folder), "object")


@query("leaf_group_members", _members_sql("object"))
def leaf_group_members(spark, folder):
    docs = derived.documents(spark, folder).drop("text")
    return links.group_members(docs, links.cross_split_groups(docs, "object"), "object")


@query(
    "exact_pairs",
    f"""WITH {DOCS}
SELECT a.digest, a.split AS split_a, b.split AS split_b, count(DISTINCT a.id) AS copies_a, count(DISTINCT b.id) AS copies_b,
       min(a.id) AS first_id_a, min(b.id) AS first_id_b, arg_min(a.class, a.id) AS first_class_a, arg_min(b.class, b.id) AS first_class_b, count(*) AS pairs
FROM docs a JOIN docs b ON a.digest = b.digest AND a.split < b.split GROUP BY a.digest, a.split, b.split""",
)
def exact_pairs(spark, folder):
    return links.exact_pairs(derived.documents(spark, folder))


@query(
    "exact_pair_totals",
    f"""WITH {DOCS}
SELECT a.split || '--' || b.split AS split_pair, count(*) AS pairs, count(DISTINCT a.digest) AS groups
FROM docs a JOIN docs b ON a.digest = b.digest AND a.split < b.split GROUP BY 1""",
)
def exact_pair_totals(spark, folder):
    return links.exact_pair_totals(derived.documents(spark, folder))


@query(
    "cross_exact_pairs",
    f"""WITH {DOCS}
SELECT a.digest, count(DISTINCT a.id) AS left_copies, min(a.id) AS left_first_id, count(DISTINCT b.id) AS right_copies, min(b.id) AS right_first_id, count(*) AS pairs
FROM docs a JOIN docs b ON a.digest = b.digest WHERE a.split = 'train' AND b.split = 'test' GROUP BY a.digest""",
)
def cross_exact_pairs(spark, folder):
    docs = derived.digests(spark, folder)
    return links.two_sided_pairs(docs.filter("split = 'train'"), docs.filter("split = 'test'"))


# --- cleanup against the locked test -------------------------------------------------------

_CLEAN = f"""WITH {DOCS},
tr AS (SELECT * FROM docs WHERE split = 'train'), te AS (SELECT * FROM docs WHERE split = 'test'),
x1 AS (SELECT * FROM tr WHERE digest IN (SELECT digest FROM te)),
k1 AS (SELECT * FROM tr WHERE digest NOT IN (SELECT digest FROM te)),
x2 AS (SELECT * FROM k1 WHERE object IS NOT NULL AND object IN (SELECT object FROM te WHERE object IS NOT NULL)),
k2 AS (SELECT * FROM k1 WHERE id NOT IN (SELECT id FROM x2))"""


@query("collision_clean", f"{_CLEAN} SELECT id, class, digest, object FROM k2")
def collision_clean(spark, folder):
    kept, _ = cleanup.clean_against_test(derived.digests(spark, folder))
    return kept.select("id", "class", "digest", "object")


@query(
    "collision_log",
    f"""{_CLEAN} SELECT id, class, split, 'exact_digest_overlap_with_test' AS reason FROM x1
UNION ALL SELECT id, class, split, 'object_overlap_with_test' AS reason FROM x2""",
)
def collision_log(spark, folder):
    _, log = cleanup.clean_against_test(derived.digests(spark, folder))
    return log


# --- metadata ------------------------------------------------------------------------------


@query(
    "leaf_coverage",
    f"""{_CLEAN} SELECT count(*) AS records, count(object) AS mapped, count(*) - count(object) AS unmapped,
       (SELECT count(*) FROM x1) + (SELECT count(*) FROM x2) AS removed,
       round(count(object) / greatest(count(*) + (SELECT count(*) FROM x1) + (SELECT count(*) FROM x2), 1), 6) AS coverage
FROM k2""",
)
def leaf_coverage(spark, folder):
    kept, log = cleanup.clean_against_test(derived.digests(spark, folder))
    return profile.coverage(kept, removed=log)


@query(
    "leaf_resolve",
    f"""WITH {DOCS}, map AS (
  SELECT 'obj ' || (id // 5) AS identifier, list(DISTINCT object ORDER BY object) AS suggestions
  FROM docs WHERE object IS NOT NULL GROUP BY 1),
named AS (SELECT id, class, 'obj ' || (id // 5) AS identifier FROM docs)
SELECT id, n.class, identifier,
       CASE WHEN len(suggestions) = 1 THEN suggestions[1]
            WHEN len(suggestions) > 1 THEN list_filter(suggestions, lambda s: contains(s, n.class))[1] END AS object
FROM named n LEFT JOIN map USING (identifier)""",
)
def leaf_resolve(spark, folder):
    docs = derived.documents(spark, folder)
    identifier = names.object_identifier(F.concat(F.lit("set___Obj "), F.expr("id div 5"), F.lit(" copy 2.JPG")))
    named = docs.withColumn("identifier", identifier)
    suggestions = named.filter(F.col("object").isNotNull()).groupBy("identifier").agg(
        F.array_sort(F.collect_set("object")).alias("suggestions")
    )
    return cleanup.resolve_objects(named.select("id", "class", "identifier"), suggestions).select("id", "class", "identifier", "object")


@query(
    "list_resolution",
    """WITH lines AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS line FROM pages),
parts AS (SELECT page_id, line, string_split(trim(replace(line, '\\', '/'), '/'), '/') AS p FROM lines),
keyed AS (SELECT page_id, line, p[-2] AS class_name, lower(p[-1]) AS file_key FROM parts),
idx AS (SELECT class_name, file_key, count(*) AS n, min(page_id) AS page_id FROM keyed GROUP BY 1, 2)
SELECT k.line, k.class_name, k.file_key, coalesce(n, 0) AS local_match_count, CASE WHEN n = 1 THEN idx.page_id END AS page_id
FROM keyed k LEFT JOIN idx ON idx.class_name = k.class_name AND idx.file_key = k.file_key""",
)
def list_resolution(spark, folder):
    pages = derived.table(spark, folder, "pages").withColumn("line", F.regexp_replace("url", "[?#].*$", ""))
    listed = cleanup.parsed_list(pages)
    index = pages.select(
        names.listed_class(F.col("line")).alias("class_name"), F.lower(names.listed_file(F.col("line"))).alias("file_key"), "page_id"
    )
    return cleanup.resolve_once(listed, index, ["class_name", "file_key"], ["page_id"])


# --- near duplicates -----------------------------------------------------------------------


@query("fingerprints", f"WITH {FDOCS} SELECT id, class, lower(to_hex(fp)) AS fp FROM fdocs")
def fingerprints(spark, folder):
    return derived.fingerprints(spark, folder).select("id", "class", F.lower(F.hex("fp")).alias("fp"))


def _near_nodes(threshold: int) -> str:
    """Record pairs of two splits, compared one by one and then counted per pair of (fingerprint, split)."""
    return f"""nodes AS (
  SELECT a.class, bit_count(xor(a.fp, b.fp))::INTEGER AS distance, a.fp AS fp_a, a.split AS split_a, count(DISTINCT a.id) AS copies_a, min(a.id) AS first_id_a,
         b.fp AS fp_b, b.split AS split_b, count(DISTINCT b.id) AS copies_b, min(b.id) AS first_id_b, count(*) AS pairs
  FROM fdocs a JOIN fdocs b ON a.class = b.class AND a.split < b.split
  WHERE bit_count(xor(a.fp, b.fp)) <= {threshold} GROUP BY a.class, a.fp, a.split, b.fp, b.split)"""


def _hex(*columns: str) -> str:
    return ", ".join(f"lower(to_hex({c})) AS {c}" for c in columns)


_NODE_COLUMNS = f"class, distance, {_hex('fp_a', 'fp_b')}, split_a, split_b, copies_a, copies_b, first_id_a, first_id_b, pairs"


def _readable(df, *columns):
    return df.withColumns({c: F.lower(F.hex(c)) for c in columns})


@query("near_pairs_strict", f"WITH {FDOCS}, {_near_nodes(4)} SELECT {_NODE_COLUMNS} FROM nodes")
def near_pairs_strict(spark, folder):
    return _readable(links.near_node_pairs(derived.fingerprints(spark, folder), 4), "fp_a", "fp_b")


@query("near_pairs_review", f"WITH {FDOCS}, {_near_nodes(8)} SELECT {_NODE_COLUMNS} FROM nodes")
def near_pairs_review(spark, folder):
    return _readable(links.near_node_pairs(derived.fingerprints(spark, folder), 8), "fp_a", "fp_b")


@query(
    "linked_ids",
    f"WITH {FDOCS}, {near(4)} SELECT id_a AS id FROM near UNION SELECT id_b FROM near",
)
def linked_ids(spark, folder):
    records = derived.fingerprints(spark, folder)
    return links.linked_ids(records, links.near_node_pairs(records, 4)).select("id")


_REMOVE_A = f"{PRIORITY.format('split_a')} < {PRIORITY.format('split_b')}"


@query(
    "quarantine_log",
    f"""WITH {FDOCS}, {_near_nodes(4)}
SELECT class, distance, {", ".join(f"CASE WHEN {_REMOVE_A} THEN {c}_{x} ELSE {c}_{y} END AS {side}_{c}" for side, x, y in (("removed", "a", "b"), ("protected", "b", "a")) for c in ("split", "copies", "first_id"))},
       lower(to_hex(CASE WHEN {_REMOVE_A} THEN fp_a ELSE fp_b END)) AS removed_fp, lower(to_hex(CASE WHEN {_REMOVE_A} THEN fp_b ELSE fp_a END)) AS protected_fp,
       pairs, 'strict_cross_split_dhash_quarantine' AS reason FROM nodes""",
)
def quarantine_log(spark, folder):
    _, log, _ = audit.quarantined_manifest(derived.fingerprints(spark, folder))
    return _readable(log, "removed_fp", "protected_fp")


_GONE = f"""gone AS (SELECT DISTINCT CASE WHEN {_REMOVE_A} THEN id_a ELSE id_b END AS id FROM near)"""


@query(
    "quarantine_manifest",
    f"WITH {FDOCS}, {near(4)}, {_GONE} SELECT id, class, split FROM docs WHERE id NOT IN (SELECT id FROM gone)",
)
def quarantine_manifest(spark, folder):
    cleaned, _, _ = audit.quarantined_manifest(derived.fingerprints(spark, folder))
    return cleaned.select("id", "class", "split")


_LISTED = f"""WITH {FDOCS}, {_near_nodes(4)}, listed AS (SELECT distance, first_id_a AS id_a, first_id_b AS id_b, split_a, split_b FROM nodes)"""


def _listed_pairs(spark, folder):
    """One pair of record ids per pair of nodes, written as the file that a review hands over, and read again."""
    records = derived.fingerprints(spark, folder)
    pairs = links.near_node_pairs(records, 4).select("distance", F.col("first_id_a").alias("id_a"), F.col("first_id_b").alias("id_b"))
    path = f"{own_folder(spark)}/pairs-{uuid.uuid4().hex}"
    sinks.write_csv(pairs, path)
    return records, spark.read.schema("distance int, id_a bigint, id_b bigint").csv(path, header=True)


@query(
    "listed_quarantine_log",
    f"""{_LISTED} SELECT distance, {", ".join(f"CASE WHEN {_REMOVE_A} THEN {c}_{x} ELSE {c}_{y} END AS {side}_{c}" for side, x, y in (("removed", "a", "b"), ("protected", "b", "a")) for c in ("id", "split"))},
  'strict_cross_split_dhash_quarantine' AS reason FROM listed""",
)
def listed_quarantine_log(spark, folder):
    records, pairs = _listed_pairs(spark, folder)
    return cleanup.quarantine_listed(pairs, records)[0]


@query(
    "listed_quarantine_manifest",
    f"""{_LISTED}, gone AS (SELECT DISTINCT CASE WHEN {_REMOVE_A} THEN id_a ELSE id_b END AS id FROM listed)
SELECT id, class, split, (SELECT count(*) FROM listed WHERE id_a NOT IN (SELECT id FROM gone) AND id_b NOT IN (SELECT id FROM gone)) AS surviving
FROM docs WHERE id NOT IN (SELECT id FROM gone)""",
)
def listed_quarantine_manifest(spark, folder):
    """The manifest without the removed side of every listed pair, and how many listed pairs are still in it: none."""
    records, pairs = _listed_pairs(spark, folder)
    _, cleaned = cleanup.quarantine_listed(pairs, records)
    surviving = cleanup.surviving_listed(pairs, cleaned).agg(F.count("*").alias("n"))
    return cleaned.select("id", "class", "split", surviving.scalar().alias("surviving"))


@query(
    "quarantine_removed",
    f"WITH {FDOCS}, {near(4)}, {_GONE} SELECT split, count(*) AS removed FROM docs WHERE id IN (SELECT id FROM gone) GROUP BY split",
)
def quarantine_removed(spark, folder):
    records = derived.fingerprints(spark, folder)
    nodes = cleanup.quarantined_nodes(links.near_node_pairs(records, 4))
    return cleanup.removed_per_split(cleanup.quarantined_records(records, nodes))


@query(
    "quarantine_removed_ids",
    f"WITH {FDOCS}, {near(4)}, {_GONE} SELECT id, class, split FROM docs WHERE id IN (SELECT id FROM gone)",
)
def quarantine_removed_ids(spark, folder):
    records = derived.fingerprints(spark, folder)
    nodes = cleanup.quarantined_nodes(links.near_node_pairs(records, 4))
    return cleanup.quarantined_records(records, nodes).select("id", "class", "split")


_FLAGGED = f"""WITH {FDOCS},
glist AS (SELECT id, list(n::DOUBLE ORDER BY cell) AS g FROM grid GROUP BY id),
described AS (
  SELECT a.class, bit_count(xor(a.fp, b.fp))::INTEGER AS distance, a.id AS id_a, b.id AS id_b, a.fp AS fp_a, b.fp AS fp_b, a.split AS split_a, b.split AS split_b,
         a.object AS object_a, b.object AS object_b, a.object IS NULL OR b.object IS NULL AS unmapped, ga.g AS ga, gb.g AS gb
  FROM fdocs a JOIN fdocs b ON a.class = b.class AND a.split < b.split
  JOIN glist ga ON ga.id = a.id JOIN glist gb ON gb.id = b.id WHERE bit_count(xor(a.fp, b.fp)) <= 8),
measured AS (
  SELECT *, list_inner_product(ga, gb) / (sqrt(list_inner_product(ga, ga)) * sqrt(list_inner_product(gb, gb))) AS embedding_cosine,
         list_sum(list_transform(range(1, 73), lambda i: abs(ga[i] / list_max(ga) - gb[i] / list_max(gb)))) / 72 AS mae,
         72 * list_inner_product(ga, ga) - list_sum(ga) * list_sum(ga) AS va, 72 * list_inner_product(gb, gb) - list_sum(gb) * list_sum(gb) AS vb,
         72 * list_inner_product(ga, gb) - list_sum(ga) * list_sum(gb) AS vab
  FROM described),
correlated AS (SELECT *, CASE WHEN va <= 0 OR vb <= 0 THEN 0.0 ELSE vab / (sqrt(va) * sqrt(vb)) END AS correlation FROM measured),
flagged AS (SELECT *, correlation >= 0.995 AND mae <= 0.03 AS pixel_flag, embedding_cosine >= 0.990 AS embedding_flag FROM correlated)"""


def _review(spark, folder):
    """(content pairs with metrics and flags, node pairs, records) of the review distance."""
    records = derived.fingerprints(spark, folder)
    node_pairs = materialise(links.near_node_pairs(records, 8))
    measured = review.measured_pairs(review.content_pairs(node_pairs, records, "grid"))
    return review.flagged_pairs(measured), node_pairs, records


@query(
    "near_review",
    f"""{_FLAGGED}, contents AS (
  SELECT class, distance, split_a || '--' || split_b AS split_pair, min(id_a) AS first_id_a, min(id_b) AS first_id_b, distance <= 4 AS strict, count(*) AS pairs,
         count(*) FILTER (WHERE unmapped) AS unmapped_pairs, bool_or(unmapped) AS involves_unmapped, round(any_value(embedding_cosine), 6) AS embedding_cosine,
         round(any_value(mae), 6) AS mae, round(any_value(correlation), 6) + 0.0 AS correlation, any_value(pixel_flag) AS pixel_flag, any_value(embedding_flag) AS embedding_flag
  FROM flagged GROUP BY class, distance, fp_a, fp_b, split_a, split_b, ga, gb)
SELECT *, involves_unmapped OR pixel_flag OR embedding_flag AS priority FROM contents""",
)
def near_review(spark, folder):
    return _review(spark, folder)[0].select(
        "class", "distance", "split_pair", "first_id_a", "first_id_b", "strict", "pairs", "unmapped_pairs", "involves_unmapped", "embedding_cosine", "mae",
        "correlation", "pixel_flag", "embedding_flag", "priority",
    )


@query(
    "near_review_summary",
    f"""{_FLAGGED} SELECT count(*) AS pairs, count(*) FILTER (WHERE unmapped) AS unmapped_pairs,
  count(*) FILTER (WHERE NOT unmapped) AS mapped_pairs,
  count(*) FILTER (WHERE NOT unmapped AND object_a = object_b) AS mapped_same_object,
  round(max(embedding_cosine), 6) AS max_cosine, round(max(embedding_cosine) FILTER (WHERE unmapped), 6) AS max_cosine_unmapped,
  round(max(correlation) FILTER (WHERE unmapped), 6) AS max_correlation_unmapped,
  round(min(mae) FILTER (WHERE unmapped), 6) AS min_mae_unmapped,
  count(*) FILTER (WHERE unmapped AND embedding_flag) AS unmapped_embedding_flags,
  count(*) FILTER (WHERE unmapped AND pixel_flag) AS unmapped_pixel_flags FROM flagged""",
)
def near_review_summary(spark, folder):
    records = derived.fingerprints(spark, folder)
    found = links.near_node_pairs(review.packed_contents(records), 8, totals=review.PAIR_TOTALS)
    return review.tiled_summary(found, records, same_object=review.same_object_totals(records, 8))


@query(
    "split_pair_distribution",
    f"""WITH {FDOCS}, {near(4)}
SELECT least(split_a, split_b) || '--' || greatest(split_a, split_b) AS split_pair, count(*) AS pairs FROM near GROUP BY 1""",
)
def split_pair_distribution(spark, folder):
    pairs = links.near_node_pairs(derived.fingerprints(spark, folder), 4)
    return review.split_pair_distribution(pairs.withColumn("split_pair", names.split_pair(F.col("split_a"), F.col("split_b"))))


# --- components and group-aware splits -----------------------------------------------------

_COMPONENTS = f"""WITH RECURSIVE {FDOCS},
edges AS (
  SELECT a.id AS x, b.id AS y FROM fdocs a JOIN fdocs b ON a.id <> b.id AND (a.digest = b.digest OR a.object = b.object
    OR (a.class = b.class AND bit_count(xor(a.fp, b.fp)) <= 4))),
reach AS (SELECT id AS x, id AS y FROM docs UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
comp AS (SELECT d.id, d.class, d.split, c.component FROM docs d JOIN (SELECT x, min(y) AS component FROM reach GROUP BY x) c ON c.x = d.id),
ctab AS (SELECT component, count(*) AS size, count(DISTINCT class) AS classes, min(class) AS class FROM comp GROUP BY component)"""


@query("components", f"{_COMPONENTS} SELECT id, class, split, component FROM comp")
def record_components(spark, folder):
    return components.record_components(derived.fingerprints(spark, folder))


@query(
    "group_numbering",
    f"""{_COMPONENTS} SELECT component, size, classes, class,
  'strict_group_' || lpad((row_number() OVER (ORDER BY component) - 1)::VARCHAR, 6, '0') AS group_id FROM ctab""",
)
def group_numbering(spark, folder):
    members = components.record_components(derived.fingerprints(spark, folder))
    return components.numbered_groups(components.component_table(members))


@query(
    "link_counts",
    f"""WITH {FDOCS}
SELECT 'exact' AS evidence, coalesce(sum(n - 1), 0)::BIGINT AS links FROM (SELECT count(*) AS n FROM docs GROUP BY digest)
UNION ALL SELECT 'near', (SELECT count(*) FROM fdocs a JOIN fdocs b ON a.class = b.class AND a.id < b.id WHERE bit_count(xor(a.fp, b.fp)) <= 4)""",
)
def link_counts(spark, folder):
    return components.link_counts(derived.fingerprints(spark, folder))


_PREFIX = f"""WITH {DOCS},
grouped AS (SELECT id, class, coalesce('leaf::' || object, 'unmapped_hash::' || digest) AS grp FROM docs WHERE split = 'train'),
g AS (SELECT class, grp, count(*) AS size, {h60("'validation:42:' || class || ':' || grp")} AS hash FROM grouped GROUP BY class, grp),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY class ORDER BY hash, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        row_number() OVER (PARTITION BY class ORDER BY hash, grp) AS rn, count(*) OVER (PARTITION BY class) AS groups,
        sum(size) OVER (PARTITION BY class) AS total FROM g),
assigned AS (SELECT class, grp, size, CASE WHEN before < greatest(round_even(total * 0.1, 0), 1) AND rn < groups THEN 'validation' ELSE 'train' END AS split FROM w)"""


def _train_groups(spark, folder):
    docs = derived.digests(spark, folder).filter("split = 'train'")
    return docs.withColumn("group", names.group_key(F.col("object"), F.col("digest")))


@query("validation_prefix", f'{_PREFIX} SELECT class, grp AS "group", size, split FROM assigned')
def validation_prefix(spark, folder):
    return splits.validation_prefix(splits.group_sizes(_train_groups(spark, folder)), 0.1)


@query(
    "class_split_summary",
    f"""{_PREFIX} SELECT g.class, count(*) AS records, count(DISTINCT g.grp) AS groups,
  count(*) FILTER (WHERE a.split = 'train') AS train_records, count(*) FILTER (WHERE a.split = 'validation') AS validation_records,
  count(*) FILTER (WHERE a.split = 'test') AS test_records
FROM grouped g JOIN assigned a ON a.class = g.class AND a.grp = g.grp GROUP BY g.class""",
)
def class_split_summary(spark, folder):
    records = _train_groups(spark, folder)
    return splits.class_split_summary(
        splits.apply_group_split(records, splits.validation_prefix(splits.group_sizes(records), 0.1))
    )


@query(
    "safe_manifest",
    f"""{_CLEAN.replace("split = 'train'", "split <> 'test'")},
grouped AS (SELECT id, class, coalesce('leaf::' || object, 'unmapped_hash::' || digest) AS grp FROM k2),
g AS (SELECT class, grp, count(*) AS size, {h60("'validation:42:' || class || ':' || grp")} AS hash FROM grouped GROUP BY class, grp),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY class ORDER BY hash, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        row_number() OVER (PARTITION BY class ORDER BY hash, grp) AS rn, count(*) OVER (PARTITION BY class) AS groups,
        sum(size) OVER (PARTITION BY class) AS total FROM g)
SELECT d.id, d.class, CASE WHEN before < greatest(round_even(total * 0.1, 0), 1) AND rn < groups THEN 'validation' ELSE 'train' END AS split
FROM grouped d JOIN w ON w.class = d.class AND w.grp = d.grp
UNION ALL SELECT id, class, split FROM te""",
)
def safe_manifest(spark, folder):
    # The official lists know two splits; the derived validation part belongs to the training side here.
    two = derived.digests(spark, folder).withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train"))
    manifest, _ = audit.leakage_safe_manifest(two, 0.1)
    return manifest.select("id", "class", "split")


_GROUPS = f"""WITH RECURSIVE {DOCS},
g AS (SELECT class, coalesce('leaf::' || object, 'unmapped_hash::' || digest) AS grp, count(*) AS size FROM docs GROUP BY 1, 2)"""
_FOLD = f"""o AS (SELECT *, {h60("'greedy:42:' || class || ':' || grp")} AS hash FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY size DESC, hash, grp) AS rn,
        row_number() OVER (PARTITION BY class, size ORDER BY hash, grp) AS in_run FROM o),
fold AS (
  SELECT class, rn, size, size AS t, 0::BIGINT AS v, 0::BIGINT AS s, 'train' AS split FROM r WHERE rn = 1
  UNION ALL
  SELECT r.class, r.rn, r.size,
         f.t + CASE WHEN pick = 'train' THEN r.size ELSE 0 END, f.v + CASE WHEN pick = 'validation' THEN r.size ELSE 0 END,
         f.s + CASE WHEN pick = 'test' THEN r.size ELSE 0 END, pick
  FROM (SELECT *, CASE WHEN rn = 1 THEN 'validation' WHEN rn = 2 THEN 'test' WHEN t <= 8 * v AND t <= 8 * s THEN 'train'
               WHEN v <= s THEN 'validation' ELSE 'test' END AS pick FROM fold) f
  JOIN r ON r.class = f.class AND r.rn = f.rn + 1),
runs AS (SELECT class, size, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
           count(*) FILTER (WHERE split = 'test') AS n_test FROM fold GROUP BY class, size)"""
_GREEDY = f"{_GROUPS},\n{_FOLD}"
_PLACED = "CASE WHEN in_run <= n_train THEN 'train' WHEN in_run <= n_train + n_validation THEN 'validation' ELSE 'test' END"


def _all_groups(spark, folder):
    docs = derived.digests(spark, folder)
    return splits.group_sizes(docs.withColumn("group", names.group_key(F.col("object"), F.col("digest"))))


@query("greedy_runs", f"{_GREEDY} SELECT class, size, n_train, n_validation, n_test FROM runs")
def greedy_runs(spark, folder):
    return splits.greedy_run_table(_all_groups(spark, folder))


@query(
    "greedy_split",
    f"""{_GREEDY} SELECT r.class, r.grp AS "group", r.size, CASE WHEN in_run <= n_train THEN 'train'
  WHEN in_run <= n_train + n_validation THEN 'validation' ELSE 'test' END AS split
FROM r JOIN runs u ON u.class = r.class AND u.size = r.size""",
)
def greedy_split(spark, folder):
    return splits.greedy_split(_all_groups(spark, folder))


@query(
    "component_split",
    f"""{_COMPONENTS}, g AS (SELECT class, component::VARCHAR AS grp, count(*) AS size FROM comp GROUP BY 1, 2), {_FOLD}
SELECT c.id, c.class, c.component, {_PLACED} AS split FROM comp c JOIN r ON r.class = c.class AND r.grp = c.component::VARCHAR
JOIN runs u ON u.class = r.class AND u.size = r.size""",
)
def component_split(spark, folder):
    """Whole components, linked by contents, objects and near hashes, dealt to the three parts, on any table as its SQL does."""
    placed, _ = audit.component_assignment(derived.fingerprints(spark, folder))
    return placed.select("id", "class", "component", "split")


@query(
    "half_split",
    f"""WITH {DOCS}, n AS (SELECT class, count(*) AS n FROM docs GROUP BY class),
odd AS (SELECT class, row_number() OVER (ORDER BY {h60("'half-odd:42:' || class")}, class) AS o, count(*) OVER () AS odds FROM n WHERE n % 2 = 1),
q AS (SELECT n.class, n // 2 + CASE WHEN o <= ceil(odds / 2.0) THEN 1 ELSE 0 END AS t FROM n LEFT JOIN odd USING (class)),
r AS (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY {h60("'half:42:' || id")}, id) AS rn FROM docs)
SELECT id, class, CASE WHEN rn <= t THEN 'test' ELSE 'validation' END AS split FROM r JOIN q USING (class)""",
)
def half_split(spark, folder):
    return splits.half_split(derived.documents(spark, folder).select("id", "class")).select("id", "class", "split")


@query(
    "balanced_sample",
    f"""SELECT id, class FROM (
  SELECT o_orderkey AS id, o_orderpriority AS class,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h60("'sample:42:' || o_orderkey")}, o_orderkey) AS rn FROM orders)
WHERE rn <= 200""",
)
def balanced_sample(spark, folder):
    orders = derived.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"))
    return splits.balanced_sample(orders, 200)


@query(
    "label_permutation",
    f"""WITH a AS (SELECT vec_id AS id, label AS class, row_number() OVER (ORDER BY {h60("'slot:42:' || vec_id")}, vec_id) AS rn FROM embeddings),
b AS (SELECT label AS permuted, row_number() OVER (ORDER BY {h60("'label:42:' || vec_id")}, vec_id) AS rn FROM embeddings)
SELECT id, class::BIGINT AS class, permuted::BIGINT AS permuted FROM a JOIN b USING (rn)""",
)
def label_permutation(spark, folder):
    return splits.permuted_labels(derived.embeddings(spark, folder).withColumnRenamed("target", "class"))


# --- embedding neighbours ------------------------------------------------------------------

_NEAREST = f"""WITH {EMB},
u AS (SELECT id, target AS class, split, object, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS v FROM emb),
n AS (SELECT class, split, count(*) AS n FROM u GROUP BY 1, 2),
sp AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) t(a, b)),
sides AS (
  SELECT x.class, CASE WHEN x.n <= y.n THEN a ELSE b END AS query_split, CASE WHEN x.n <= y.n THEN b ELSE a END AS candidate_split
  FROM sp JOIN n x ON x.split = a JOIN n y ON y.split = b AND y.class = x.class),
best AS (
  SELECT s.class, query_split, candidate_split, q.id AS query_id, arg_min(c.id, (-list_inner_product(q.v, c.v), c.id)) AS candidate_id,
         max(list_inner_product(q.v, c.v)) AS similarity
  FROM sides s JOIN u q ON q.class = s.class AND q.split = query_split JOIN u c ON c.class = s.class AND c.split = candidate_split
  GROUP BY 1, 2, 3, 4)"""


@query(
    "embedding_top1",
    f"{_NEAREST} SELECT class::BIGINT AS class, query_split, candidate_split, query_id, candidate_id, round(similarity, 6) AS similarity FROM best",
)
def embedding_top1(spark, folder):
    return neighbours.nearest_across_splits(derived.embeddings(spark, folder).withColumnRenamed("target", "class"))


@query(
    "embedding_top_pairs",
    f"""{_NEAREST},
once AS (SELECT *, row_number() OVER (PARTITION BY least(query_id, candidate_id), greatest(query_id, candidate_id) ORDER BY similarity DESC, query_id) AS k FROM best),
top AS (SELECT * FROM once WHERE k = 1 ORDER BY similarity DESC, query_id, candidate_id LIMIT 200)
SELECT t.class::BIGINT AS class, least(query_split, candidate_split) || '--' || greatest(query_split, candidate_split) AS split_pair,
       query_id, candidate_id, round(similarity, 6) AS similarity, similarity >= 0.9995 AS very_high, similarity >= 0.995 AS high,
       q.object IS NULL OR c.object IS NULL AS involves_unmapped
FROM top t JOIN emb q ON q.id = query_id JOIN emb c ON c.id = candidate_id""",
)
def embedding_top_pairs(spark, folder):
    records = derived.embeddings(spark, folder).withColumnRenamed("target", "class")
    return neighbours.top_neighbour_pairs(neighbours.nearest_across_splits(records), records)


# --- contracts -----------------------------------------------------------------------------


def _in_several(key: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM docs WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(DISTINCT split) > 1))"


@query(
    "split_violations",
    f"""WITH {DOCS}, v AS (
  SELECT 'digest_in_one_split' AS "check", {_in_several('digest')} AS violations
  UNION ALL SELECT 'object_in_one_split', {_in_several('object')}
  UNION ALL SELECT 'id_in_one_split', {_in_several('id')}
  UNION ALL SELECT 'class_in_every_split', (SELECT count(*) FROM (SELECT DISTINCT class FROM docs) c, (SELECT unnest(['train','validation','test']) AS split) s
     WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.class = c.class AND d.split = s.split))
  UNION ALL SELECT 'split_names', (SELECT count(DISTINCT split) FROM docs WHERE split NOT IN ('train', 'validation', 'test'))
     + (SELECT 3 - count(DISTINCT split) FROM docs WHERE split IN ('train', 'validation', 'test')))
SELECT "check", violations, violations = 0 AS passed FROM v""",
)
def split_violations(spark, folder):
    return checks.split_integrity(derived.digests(spark, folder), ["digest", "object", "id"])


def _pairs_overlap(key: str, a: str, b: str) -> str:
    return f"(SELECT count(DISTINCT {key}) FROM docs WHERE split = '{a}' AND {key} IN (SELECT {key} FROM docs WHERE split = '{b}' AND {key} IS NOT NULL))"


_SPLIT_PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]


@query(
    "set_checks",
    f"WITH {DOCS}, v AS ("
    + " UNION ALL ".join(
        f"""SELECT '{key}_overlap_{a}_{b}' AS "check", {_pairs_overlap(key, a, b)} AS violations"""
        for key in ("id", "digest", "object")
        for a, b in _SPLIT_PAIRS
    )
    + """ UNION ALL SELECT 'union_is_complete', (SELECT count(*) FROM (SELECT id FROM docs EXCEPT ALL SELECT id FROM docs WHERE split IN ('train', 'validation', 'test'))) UNION ALL SELECT 'ids_do_not_repeat', (SELECT count(*) FROM (SELECT id FROM docs GROUP BY id HAVING count(*) > 1)))
SELECT "check", violations, violations = 0 AS passed FROM v""",
)
def set_checks(spark, folder):
    docs = derived.digests(spark, folder)
    parts = {s: docs.filter(F.col("split") == s) for s in profile.SPLITS}
    rows = [
        checks.check(f"{key}_overlap_{a}_{b}", checks.overlap(parts[a], parts[b], key))
        for key in ("id", "digest", "object")
        for a, b in _SPLIT_PAIRS
    ]
    union = parts["train"].unionByName(parts["validation"]).unionByName(parts["test"])
    rows.append(checks.check("union_is_complete", checks.difference(docs, union, ["id"])))
    rows.append(checks.check("ids_do_not_repeat", profile.repeated_keys(docs, "id")))
    return checks.all_checks(rows)


_VERDICT_CHECKS = f"""WITH {FDOCS}, {near(4)}, v AS (
  SELECT 'exact_duplicates' AS "check", (SELECT count(*) FROM (SELECT DISTINCT a.digest, a.split, b.split AS other FROM docs a JOIN docs b ON a.digest = b.digest AND a.split < b.split)) AS violations
  UNION ALL SELECT 'same_object', (SELECT count(*) FROM (SELECT object FROM docs WHERE object IS NOT NULL GROUP BY object HAVING count(DISTINCT split) > 1))
  UNION ALL SELECT 'near_duplicates', (SELECT count(*) FROM (
     SELECT DISTINCT a.class, a.fp, a.split, b.fp AS other, b.split AS other_split FROM near n JOIN fdocs x ON x.id = n.id_a JOIN fdocs y ON y.id = n.id_b
     JOIN fdocs a ON a.id = CASE WHEN (x.fp::HUGEINT, x.split) < (y.fp::HUGEINT, y.split) THEN x.id ELSE y.id END
     JOIN fdocs b ON b.id = CASE WHEN (x.fp::HUGEINT, x.split) < (y.fp::HUGEINT, y.split) THEN y.id ELSE x.id END)))"""


@query("audit_checks", f'{_VERDICT_CHECKS} SELECT "check", violations, violations = 0 AS passed FROM v')
def audit_checks(spark, folder):
    return audit.leakage_audit(derived.fingerprints(spark, folder)).checks


@query(
    "integrity_verdict",
    f"""{_VERDICT_CHECKS} SELECT count(*) AS checks, count(*) FILTER (WHERE violations > 0) AS failed, bool_and(violations = 0) AS passed FROM v""",
)
def integrity_verdict(spark, folder):
    return checks.verdict(audit.leakage_audit(derived.fingerprints(spark, folder)).checks)


@query(
    "audit_status",
    f"""{_VERDICT_CHECKS} SELECT "check", CASE WHEN violations = 0 THEN 'PASS' WHEN "check" = 'near_duplicates' THEN 'WARN' ELSE 'FAIL' END AS status FROM v
UNION ALL SELECT 'object_coverage', CASE WHEN count(object) / count(*) < 0.95 THEN 'WARN' ELSE 'PASS' END FROM docs""",
)
def audit_status(spark, folder):
    return audit.leakage_audit(derived.fingerprints(spark, folder)).status


@query(
    "quarantine_checks",
    f"""WITH {FDOCS}, {near(4)}, {_GONE}, kept AS (SELECT * FROM docs WHERE id NOT IN (SELECT id FROM gone)), v AS (
  SELECT 'locked_test_unchanged' AS "check", (SELECT count(*) FROM docs WHERE split = 'test' AND id NOT IN (SELECT id FROM kept)) AS violations
  UNION ALL SELECT 'no_strict_pair_survives', (SELECT count(*) FROM near WHERE id_a IN (SELECT id FROM kept) AND id_b IN (SELECT id FROM kept))
  UNION ALL SELECT 'class_in_every_split', (SELECT count(*) FROM (SELECT DISTINCT class FROM kept) c, (SELECT unnest(['train','validation','test']) AS split) s
     WHERE NOT EXISTS (SELECT 1 FROM kept d WHERE d.class = c.class AND d.split = s.split)))
SELECT "check", violations, violations = 0 AS passed FROM v""",
)
def quarantine_checks(spark, folder):
    _, _, contract = audit.quarantined_manifest(derived.fingerprints(spark, folder))
    return contract


@query(
    "listed_manifest_checks",
    """WITH lines AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS line FROM pages),
keyed AS (SELECT page_id, p[-2] AS c, lower(p[-1]) AS f FROM (SELECT page_id, string_split(trim(replace(line, '\\', '/'), '/'), '/') AS p FROM lines)),
idx AS (SELECT c, f, count(*) AS n, min(page_id) AS path FROM keyed GROUP BY 1, 2),
res AS (SELECT k.page_id, coalesce(n, 0) AS n, path FROM keyed k LEFT JOIN idx USING (c, f)), v AS (
SELECT 'index_keys_are_unique' AS "check", (SELECT count(*) FROM idx WHERE n > 1) AS violations
UNION ALL SELECT 'every_line_matches_once', (SELECT count(*) FROM res WHERE n <> 1)
UNION ALL SELECT 'no_file_listed_twice', (SELECT count(*) FROM (SELECT path FROM res WHERE n = 1 GROUP BY path HAVING count(*) > 1)))
SELECT "check", violations, violations = 0 AS passed FROM v""",
)
def listed_manifest_checks(spark, folder):
    pages = derived.table(spark, folder, "pages").select(
        F.regexp_replace("url", "[?#].*$", "").alias("line"), F.col("page_id").alias("path"), derived.split_of(F.col("page_id")).alias("split")
    )
    index = pages.select(
        names.listed_class(F.col("line")).alias("class_name"), F.lower(names.listed_file(F.col("line"))).alias("file_key"), "path"
    )
    lists = {s: pages.filter(F.col("split") == s).select("line") for s in profile.SPLITS}
    _, contract = audit.listed_manifest(lists, index)
    return contract


@query(
    "mapping_equality",
    """WITH t AS (SELECT DISTINCT o_orderpriority AS class_name, o_orderstatus FROM orders),
a AS (SELECT class_name, (row_number() OVER (ORDER BY class_name) - 1)::BIGINT AS class_index FROM (SELECT DISTINCT class_name FROM t)),
b AS (SELECT lang AS class_name, (row_number() OVER (ORDER BY lang) - 1)::BIGINT AS class_index FROM (SELECT DISTINCT lang FROM documents))
SELECT coalesce(a.class_index, b.class_index) AS class_index, coalesce(a.class_name, b.class_name) AS class_name,
       a.class_name IS NOT NULL AS in_first, b.class_name IS NOT NULL AS in_second
FROM a FULL JOIN b ON a.class_index = b.class_index AND a.class_name = b.class_name
WHERE a.class_name IS NULL OR b.class_name IS NULL""",
)
def mapping_equality(spark, folder):
    from veriset.sources.files import class_dimension

    first = class_dimension(
        derived.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("class_name"))
    )
    second = class_dimension(derived.table(spark, folder, "documents").select(F.col("lang").alias("class_name")))
    found = checks.mapping_differences(first.select("class_index", "class_name"), second.select("class_index", "class_name"))
    return found.select(
        "class_index", "class_name", F.col("in_a").isNotNull().alias("in_first"), F.col("in_b").isNotNull().alias("in_second")
    )


# --- names ---------------------------------------------------------------------------------


@query(
    "name_columns",
    """WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '___' || lower(p_type) || '___' || p_brand AS c,
                  (p_size % 9 + 1) / pow(10, p_size % 4 + 1) AS rate, p_retailprice FROM part)
SELECT p_partkey, replace(replace(c, '___', ' - '), '_', ' ') AS display_name,
       replace(substr(c, 1, instr(c, '___') - 1) || ' - ' || substr(c, instr(c, '___') + 3), '_', ' ') AS readable_name,
       c AS run_name, regexp_matches(c, '^[A-Za-z0-9][A-Za-z0-9_-]*$') AS valid_run_name,
       replace(replace(printf('%.0e', rate), '+', 'p'), '-', 'm') AS rate_token,
       printf('%.2f%%', p_size_share) AS share FROM (SELECT *, rate * 100.0 AS p_size_share FROM n)""",
)
def name_columns(spark, folder):
    part = derived.table(spark, folder, "part")
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("___"), F.lower("p_type"), F.lit("___"), "p_brand")
    rate = (F.col("p_size") % 9 + 1) / F.pow(F.lit(10.0), F.col("p_size") % 4 + 1)
    return part.select(
        "p_partkey",
        names.display_name(label).alias("display_name"),
        names.readable_name(label).alias("readable_name"),
        names.run_name_of_checkpoint(F.concat(label, F.lit("_best"))).alias("run_name"),
        names.valid_run_name(label).alias("valid_run_name"),
        names.rate_token(rate).alias("rate_token"),
        names.percent_text(rate).alias("share"),
    )


@query(
    "file_names",
    """WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '[<>:"/\\\\|?*]', '_', 'g'), '[ .]+$', '') AS base FROM pages),
d AS (SELECT page_id, url, coalesce(nullif(base, ''), 'image') AS base FROM c),
e AS (SELECT *, regexp_extract(base, '^.+(\\.[^.]+)$', 1) AS suffix FROM d)
SELECT page_id, left(base, length(base) - length(suffix)) || '__' || left(sha1(url), 10) || suffix AS safe_name,
       replace(url_encode(url), '%2F', '/') AS encoded, lower(regexp_extract(url, '\\.[^./]+$', 0)) AS extension FROM e""",
)
def file_names(spark, folder):
    pages = derived.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        names.safe_filename(F.regexp_replace("url", "^.*/", ""), F.col("url")).alias("safe_name"),
        names.percent_encoded(F.col("url")).alias("encoded"),
        names.file_extension(F.col("url")).alias("extension"),
    )
