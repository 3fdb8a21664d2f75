"""SQL text shared by the equivalent queries: the derived relations of ``derived.py`` in plain SQL."""


def h60(expression: str) -> str:
    return f"('0x' || substr(md5({expression}), 1, 15))::BIGINT"


def split_case(key: str) -> str:
    bucket = h60(f"'split:42:' || {key}") + " % 10"
    return f"CASE WHEN {bucket} < 8 THEN 'train' WHEN {bucket} = 8 THEN 'validation' ELSE 'test' END"


DOCS = f"""docs AS (
  SELECT doc_id AS id, lang AS class, source, {split_case('doc_id')} AS split, sha256(text) AS digest,
         CASE WHEN {h60("'leaf:' || doc_id")} % 4 <> 0 THEN lang || ':::' || (doc_id // 5) END AS object
  FROM documents)"""

GRIDS = f"""tokens AS (
  SELECT id, {h60('token')} % 72 AS cell
  FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents)
  WHERE token <> ''),
cellcounts AS (SELECT id, cell, count(*) AS n FROM tokens GROUP BY id, cell),
grid AS (
  SELECT d.doc_id AS id, g.cell, coalesce(c.n, 0) AS n
  FROM documents d CROSS JOIN (SELECT unnest(range(72)) AS cell) g
  LEFT JOIN cellcounts c ON c.id = d.doc_id AND c.cell = g.cell),
hashes AS (
  SELECT l.id, sum(CASE WHEN l.n > r.n THEN (1::HUGEINT << ((l.cell // 9) * 8 + l.cell % 9)::INTEGER) ELSE 0 END)::UBIGINT AS fp
  FROM grid l JOIN grid r ON r.id = l.id AND r.cell = l.cell + 1
  WHERE l.cell % 9 < 8 GROUP BY l.id),
fdocs AS (SELECT d.*, h.fp FROM docs d JOIN hashes h USING (id))"""

FDOCS = f"{DOCS},\n{GRIDS}"


def near(threshold: int) -> str:
    """Cross-split pairs within a class, smaller id first, found by comparing everything."""
    return f"""near AS (
  SELECT a.class, bit_count(xor(a.fp, b.fp))::INTEGER AS distance, a.id AS id_a, a.split AS split_a, b.id AS id_b, b.split AS split_b
  FROM fdocs a JOIN fdocs b ON a.class = b.class AND a.id < b.id AND a.split <> b.split
  WHERE bit_count(xor(a.fp, b.fp)) <= {threshold})"""


EMB = f"""emb AS (
  SELECT vec_id AS id, label AS target, {split_case('vec_id')} AS split,
         CASE WHEN {h60("'leaf:' || vec_id")} % 4 <> 0 THEN label || ':::' || (vec_id // 5) END AS object,
         list_transform(embedding, lambda x: x::DOUBLE) AS embedding
  FROM embeddings)"""


def probabilities(model: str, source: str = "emb", features: str | None = None, fit_on: str = "split = 'train'", fit_label: str = "target", extra: str = "") -> str:
    """CTEs p_<model>(id, target, k, p): softmax of the cosine to the training centroids."""
    vector = features or ("embedding[33:]" if model == "b" else "embedding")
    extra_columns = f", {extra}" if extra else ""
    extra_group = extra_columns
    return f"""
f_{model} AS (SELECT id, target, split{extra_columns}, {vector} AS v FROM {source}),
m_{model} AS (
  SELECT k, i, avg(x) AS m FROM (
    SELECT {fit_label} AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM f_{model} WHERE {fit_on})
  GROUP BY k, i),
c_{model} AS (SELECT k, list(m ORDER BY i) AS c FROM m_{model} GROUP BY k),
s_{model} AS (
  SELECT id, target, split{extra_group}, k,
         CASE WHEN list_inner_product(v, v) > 0 AND list_inner_product(c, c) > 0
              THEN 10.0 * list_inner_product(v, c) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c))) ELSE 0.0 END AS z
  FROM f_{model} CROSS JOIN c_{model}),
e_{model} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id{extra_group})) AS e FROM s_{model}),
p_{model} AS (SELECT id, target, split{extra_group}, k, e / sum(e) OVER (PARTITION BY id{extra_group}) AS p FROM e_{model})"""


def predicted(source: str, name: str = "pred", extra: str = "") -> str:
    """CTE with one row per record: arg-max label (lowest on ties), confidence and true probability."""
    by = f", {extra}" if extra else ""
    return f"""{name} AS (
  SELECT id, target AS true_index, split{by}, arg_min(k, (-p, k)) AS predicted_index, max(p) AS confidence,
         max(p) FILTER (WHERE k = target) AS true_probability, arg_min(k, (-p, k)) = target AS correct
  FROM {source} GROUP BY id, target, split{by})"""


def report(cells: str, labels: int, name: str = "rep", keys: str = "") -> str:
    """CTE with per-class counts and scores from a (keys, true_index, predicted_index, n) relation."""
    by = f"{keys}, " if keys else ""
    frame = f"(SELECT DISTINCT {keys} FROM {cells}) q CROSS JOIN " if keys else ""
    on = "".join(f" AND c.{k.strip()} = q.{k.strip()}" for k in keys.split(",")) if keys else ""
    listed = "".join(f"q.{k.strip()}, " for k in keys.split(",")) if keys else ""
    return f"""{name}_counts AS (
  SELECT {listed}l.k AS class_index,
         coalesce(sum(c.n) FILTER (WHERE c.true_index = l.k), 0)::BIGINT AS support,
         coalesce(sum(c.n) FILTER (WHERE c.predicted_index = l.k), 0)::BIGINT AS predicted,
         coalesce(sum(c.n) FILTER (WHERE c.true_index = l.k AND c.predicted_index = l.k), 0)::BIGINT AS hits
  FROM {frame}(SELECT unnest(range({labels})) AS k) l
  LEFT JOIN {cells} c ON (c.true_index = l.k OR c.predicted_index = l.k){on}
  GROUP BY {listed}l.k),
{name} AS (
  SELECT {by}class_index, support, predicted, hits,
         CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
         CASE WHEN predicted + support > 0 THEN 2.0 * hits / (predicted + support) ELSE 0.0 END AS f1,
         support - hits AS errors
  FROM {name}_counts)"""


HIST = f"""hist AS (
  SELECT user_id AS run, event_id AS epoch, value AS loss,
         ({h60("'f1:' || event_id")} % 1000) / 1000.0 AS f1,
         ({h60("'train:' || event_id")} % 1000) / 1000.0 AS train_accuracy,
         ({h60("'traineval:' || event_id")} % 1000) / 1000.0 AS train_eval_accuracy,
         ({h60("'val:' || event_id")} % 1000) / 1000.0 AS validation_accuracy,
         ({h60("'trainevalf1:' || event_id")} % 1000) / 1000.0 AS train_eval_macro_f1,
         value * 60.0 AS elapsed_seconds, ({h60("'mem:' || event_id")} % 4096)::DOUBLE AS peak_memory_mb,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position,
         count(*) OVER (PARTITION BY user_id) AS epochs
  FROM events)"""

RUNS = f"""cfg AS (
  SELECT run, CASE WHEN {h60("'partial:' || run")} % 3 <> 0 THEN size END AS total_parameters,
         CASE WHEN {h60("'partial:' || run")} % 3 = 0 THEN size END AS trainable_parameters,
         {h60("'seed:' || run")} % 3 AS seed
  FROM (SELECT DISTINCT user_id AS run, {h60("'params:' || user_id")} % 20000000 + 1000000 AS size FROM events)),
summ AS (
  SELECT run, test_examples,
         CASE WHEN {h60("'kind:' || run")} % 3 = 0 THEN wrong END AS errors,
         CASE WHEN {h60("'kind:' || run")} % 3 = 1 THEN wrong END AS test_errors,
         1.0 - wrong / test_examples AS test_accuracy,
         ({h60("'testf1:' || run")} % 1000) / 1000.0 AS test_macro_f1
  FROM (SELECT run, test_examples, {h60("'wrong:' || run")} % test_examples AS wrong
        FROM (SELECT user_id AS run, count(*) AS test_examples FROM events GROUP BY user_id)))"""


def improvements(min_gain: str = "1e-4") -> str:
    """Recursive fold over the epochs of each run: the best epoch so far after every epoch."""
    return f"""fold AS (
  SELECT run, position, epochs, epoch AS best_epoch, f1 AS best_f1, loss AS best_loss, position AS best_position
  FROM hist WHERE position = 1
  UNION ALL
  SELECT h.run, h.position, h.epochs,
         CASE WHEN (h.f1 > f.best_f1 + {min_gain}) OR (abs(h.f1 - f.best_f1) <= {min_gain} AND h.loss < f.best_loss) THEN h.epoch ELSE f.best_epoch END,
         CASE WHEN (h.f1 > f.best_f1 + {min_gain}) OR (abs(h.f1 - f.best_f1) <= {min_gain} AND h.loss < f.best_loss) THEN h.f1 ELSE f.best_f1 END,
         CASE WHEN (h.f1 > f.best_f1 + {min_gain}) OR (abs(h.f1 - f.best_f1) <= {min_gain} AND h.loss < f.best_loss) THEN h.loss ELSE f.best_loss END,
         CASE WHEN (h.f1 > f.best_f1 + {min_gain}) OR (abs(h.f1 - f.best_f1) <= {min_gain} AND h.loss < f.best_loss) THEN h.position ELSE f.best_position END
  FROM fold f JOIN hist h ON h.run = f.run AND h.position = f.position + 1)"""
