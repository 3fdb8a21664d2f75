"""One-row summaries of audit, manifest and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriset.operators import links
from veriset.plans import audit, derived, folders
from veriset.plans.catalog import query
from veriset.plans.sql_parts import DOCS, FDOCS, h60, near
from veriset.session import materialise

_PER_SPLIT = ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_records" for s in ("train", "validation", "test"))


@query(
    "audit_summary",
    f"""WITH {FDOCS}, {near(4)},
e AS (SELECT count(DISTINCT a.digest) AS exact_groups, count(*) AS exact_pairs FROM docs a JOIN docs b ON a.digest = b.digest AND a.split < b.split),
n AS (SELECT count(*) AS near_pairs FROM near),
o AS (SELECT count(*) AS objects_over_splits FROM (SELECT object FROM docs WHERE object IS NOT NULL GROUP BY object HAVING count(DISTINCT split) > 1)),
c AS (SELECT {_PER_SPLIT}, count(object) AS mapped_records, round(count(object) / greatest(count(*), 1), 6) AS coverage FROM docs)
SELECT c.*, e.*, n.*, 4::BIGINT AS near_threshold, o.*,
  CASE WHEN exact_pairs > 0 OR objects_over_splits > 0 THEN 'FAIL' WHEN near_pairs > 0 OR coverage < 0.95 THEN 'WARN' ELSE 'PASS' END AS status FROM c, e, n, o""",
)
def audit_summary(spark, folder):
    records = derived.fingerprints(spark, folder)
    return folders.audit_summary(records, audit.leakage_audit(records))


@query(
    "manifest_summary",
    f"""WITH {DOCS}, tr AS (SELECT * FROM docs WHERE split <> 'test'), te AS (SELECT * FROM docs WHERE split = 'test'),
x AS (SELECT * FROM tr WHERE digest IN (SELECT digest FROM te)), k1 AS (SELECT * FROM tr WHERE digest NOT IN (SELECT digest FROM te)),
k2 AS (SELECT * FROM k1 WHERE object IS NULL OR object NOT IN (SELECT object FROM te WHERE object IS NOT NULL)),
g AS (SELECT class, coalesce('leaf::' || object, 'unmapped_hash::' || digest) AS grp, count(*) AS size FROM k2 GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(size) OVER p, 0) AS before, row_number() OVER (PARTITION BY class ORDER BY {h60("'validation:42:' || class || ':' || grp")}, grp) AS rn,
  count(*) OVER (PARTITION BY class) AS groups, sum(size) OVER (PARTITION BY class) AS total FROM g
  WINDOW p AS (PARTITION BY class ORDER BY {h60("'validation:42:' || class || ':' || grp")}, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT coalesce(sum(size), 0)::BIGINT AS n FROM w WHERE before < greatest(round_even(total * 0.1, 0), 1) AND rn < groups)
SELECT (SELECT count(*) FROM k2) - v.n AS train_records, v.n AS validation_records, (SELECT count(*) FROM te) AS test_records,
  (SELECT round(count(object) / greatest(count(*), 1), 6) FROM k2) AS clean_coverage, (SELECT round(count(object) / greatest(count(*), 1), 6) FROM te) AS test_coverage,
  (SELECT count(*) FROM x) AS removed_exact, (SELECT count(*) FROM k1) - (SELECT count(*) FROM k2) AS removed_object FROM v""",
)
def manifest_summary(spark, folder):
    two = derived.digests(spark, folder).withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train"))
    return folders.manifest_summary(*audit.leakage_safe_manifest(two, 0.1))


@query(
    "quarantine_summary",
    f"""WITH {FDOCS}, {near(4)}, placed AS (SELECT n.*, a.object IS NULL OR b.object IS NULL AS unmapped FROM near n JOIN docs a ON a.id = id_a JOIN docs b ON b.id = id_b),
gone AS (SELECT DISTINCT CASE WHEN CASE split_a WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END < CASE split_b WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END
  THEN id_a ELSE id_b END AS id FROM near)
SELECT (SELECT count(*) FROM placed) AS strict_pairs, (SELECT count(*) FROM placed WHERE unmapped) AS unmapped_pairs,
  count(*) FILTER (WHERE split = 'train') AS removed_train, count(*) FILTER (WHERE split = 'validation') AS removed_validation,
  count(*) FILTER (WHERE split = 'test') AS removed_test FROM docs WHERE id IN (SELECT id FROM gone)""",
)
def quarantine_summary(spark, folder):
    records = derived.fingerprints(spark, folder)
    cleaned, _, _ = audit.quarantined_manifest(records)
    return folders.quarantine_summary(records, materialise(cleaned), materialise(links.near_node_pairs(records, 4)))
