"""Group-aware, stratified and balanced splits in reproducible hash order."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriset.functions.names import hash60
from veriset.operators.checks import check, enforce
from veriset.operators.prefix import block_bits, hash_block, rank_by_hash, rank_rows, running_sums
from veriset.session import materialise

DEFAULT_RATIOS = {"train": "0.8", "validation": "0.1", "test": "0.1"}


def group_sizes(records: DataFrame, group: str = "group") -> DataFrame:
    return records.groupBy("class", group).agg(F.count("*").alias("size"))


def validation_prefix(groups: DataFrame, fraction: float, group: str = "group", seed: int = 42) -> DataFrame:
    """Assign whole groups of each class to ``validation`` until the wanted share is reached.

    ``groups`` is (class, group, size). Groups come in hash order; one is taken while the count so
    far is below max(1, round(n * fraction)), and the last group of a class always stays in train.
    """
    groups = materialise(groups)
    hashed = groups.withColumn("_hash", hash60(F.lit(f"validation:{seed}:"), F.col("class"), F.lit(":"), F.col(group)))
    totals = groups.groupBy("class").agg(F.sum("size").alias("_total"), F.count("*").alias("_groups"))
    placed = running_sums(
        hashed,
        ["class"],
        ["_hash", group],
        {"_before": F.col("size"), "_position": F.lit(1).cast("bigint")},
        block=hash_block(F.col("_hash"), block_bits(groups)),
    ).join(totals, "class")
    target = F.greatest(F.bround(F.col("_total") * F.lit(fraction), 0).cast("bigint"), F.lit(1))
    taken = (F.col("_before") < target) & (F.col("_position") < F.col("_groups") - 1)
    return placed.select(
        "class", group, "size", F.when(taken, F.lit("validation")).otherwise(F.lit("train")).alias("split")
    )


def _run_assignments(ratios: dict[str, str]):
    """Kernel over the (size, count) runs of one class: how many groups of each size go to which split.

    The greedy rule hands the next group to the split with the largest (target - current) / target,
    i.e. the smallest current / target. Within a run of equal sizes those priorities only grow, so the
    run is settled by selecting its ``count`` smallest priorities, without stepping through groups. A
    class has at most sqrt(2n) distinct sizes, hence few rows here however many groups it has.
    """
    names = list(ratios)
    shares = [Fraction(r) for r in ratios.values()]

    def below(limit: Fraction, filled: int, target: Fraction, size: int) -> int:
        """How many j >= 0 satisfy (filled + j * size) / target < limit."""
        return max(0, ceil((limit * target - filled) / size))

    def settle(filled: list[int], targets: list[Fraction], size: int, count: int) -> list[int]:
        low = min(Fraction(f) / t for f, t in zip(filled, targets))
        high = low + Fraction(count * size) / min(targets) + 1
        given = [0] * len(names)
        while count - sum(given) > 8:
            middle = (low + high) / 2
            chosen = [below(middle, f, t, size) for f, t in zip(filled, targets)]
            if sum(chosen) <= count:
                low, given = middle, chosen
            else:
                high = middle
        for _ in range(count - sum(given)):
            best = min(range(len(names)), key=lambda k: ((filled[k] + given[k] * size) / targets[k], k))
            given[best] += 1
        return given

    def one_by_one(filled: list[int], targets: list[Fraction], size: int, count: int) -> list[int]:
        given = [0] * len(names)
        for _ in range(count):
            best = max(
                range(len(names)),
                key=lambda k: ((targets[k] - filled[k] - given[k] * size) / max(targets[k], 1), -k),
            )
            given[best] += 1
        return given

    def assign(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values("size", ascending=False)
        total = int((runs["size"] * runs["groups"]).sum())
        targets = [total * s for s in shares]
        filled, seeded, rows = [0] * len(names), 0, []
        for size, groups in zip(runs["size"].astype(int), runs["groups"].astype(int)):
            given, left = [0] * len(names), groups
            while left and seeded < len(names):  # one group for every split first
                given[seeded], seeded, left = given[seeded] + 1, seeded + 1, left - 1
            filled = [f + g * size for f, g in zip(filled, given)]
            rule = one_by_one if min(targets) < 1 else settle
            more = rule(filled, targets, size, left) if left else [0] * len(names)
            filled = [f + m * size for f, m in zip(filled, more)]
            rows.append((runs["class"].iloc[0], size, *[g + m for g, m in zip(given, more)]))
        return pd.DataFrame(rows, columns=["class", "size", *[f"n_{n}" for n in names]])

    return assign


def greedy_run_table(groups: DataFrame, ratios: dict[str, str] | None = None) -> DataFrame:
    """(class, size, n_train, n_validation, n_test): group counts of the greedy ratio split."""
    ratios = ratios or DEFAULT_RATIOS
    runs = groups.groupBy("class", "size").agg(F.count("*").alias("groups"))
    class_type = groups.schema["class"].dataType.simpleString()
    schema = f"class {class_type}, size bigint, " + ", ".join(f"n_{n} bigint" for n in ratios)
    return runs.groupBy("class").applyInPandas(_run_assignments(ratios), schema)


def greedy_split(groups: DataFrame, ratios: dict[str, str] | None = None, group: str = "group", seed: int = 42) -> DataFrame:
    """Assign whole groups of each class to splits by the greedy ratio rule.

    Groups come by size, largest first, in hash order among equals. Every split gets one of the first
    groups; each further group goes where the deficit relative to the target is largest.
    """
    ratios = ratios or DEFAULT_RATIOS
    groups = materialise(groups)
    hashed = groups.withColumn("_hash", hash60(F.lit(f"greedy:{seed}:"), F.col("class"), F.lit(":"), F.col(group)))
    ranked = rank_rows(hashed, ["class", "size"], ["_hash", group], "_rank", block=hash_block(F.col("_hash")))
    placed = ranked.join(greedy_run_table(groups, ratios), ["class", "size"])
    names = list(ratios)
    split, ceiling = F.lit(names[-1]), F.lit(0).cast("bigint")
    bounds = []
    for name in names[:-1]:
        ceiling = ceiling + F.col(f"n_{name}")
        bounds.append((name, ceiling))
    for name, upper in reversed(bounds):
        split = F.when(F.col("_rank") <= upper, F.lit(name)).otherwise(split)
    return placed.select("class", group, "size", split.alias("split"))


def too_few_groups(groups: DataFrame, least: int) -> DataFrame:
    return groups.groupBy("class").agg(F.count("*").alias("groups")).filter(F.col("groups") < least)


def apply_group_split(records: DataFrame, assignment: DataFrame, group: str = "group") -> DataFrame:
    return records.drop("split").join(assignment.select("class", group, "split"), ["class", group])


def half_split(records: DataFrame, seed: int = 42) -> DataFrame:
    """Stratified halves: test gets ceil(n/2) rows in all, every class within one row of its half."""
    hashed = records.withColumn("_hash", hash60(F.lit(f"half:{seed}:"), F.col("id")))
    ranked = rank_rows(hashed, ["class"], ["_hash", "id"], "_rank", block=hash_block(F.col("_hash"), block_bits(records)))
    sizes = records.groupBy("class").agg(F.count("*").alias("_n"))
    odd = sizes.filter(F.col("_n") % 2 == 1)
    extra = rank_rows(
        odd.withColumn("_order", hash60(F.lit(f"half-odd:{seed}:"), F.col("class"))), [], ["_order", "class"], "_odd",
        block=hash_block(F.col("_order"), 2),
    ).select("class", "_odd")
    odd_classes = odd.agg(F.count("*").alias("n"))
    quotas = (
        sizes.join(extra, "class", "left")
        .select("*", odd_classes.scalar().alias("_odd_classes"))
        .select(
            "class",
            # half of the odd classes, rounded up, give their middle row to test
            (F.expr("_n div 2") + F.coalesce((F.col("_odd") <= F.ceil(F.col("_odd_classes") / 2)).cast("bigint"), F.lit(0))).alias("_test"),
        )
    )
    side = F.when(F.col("_rank") <= F.col("_test"), F.lit("test")).otherwise(F.lit("validation"))
    return ranked.join(quotas, "class").withColumn("split", side).drop("_rank", "_test", "_hash")


def balanced_sample(records: DataFrame, per_class: int, seed: int = 42, id_column: str = "id") -> DataFrame:
    """``per_class`` records of every class in hash order; a class with fewer records fails the call.

    Every task keeps its first ones of each class before the shuffle: a limit on ranks is taken there already.
    """
    enforce(check("every_class_has_enough_records", short_classes(records, per_class)))
    order = Window.partitionBy("class").orderBy(hash60(F.lit(f"sample:{seed}:"), F.col(id_column)), id_column)
    return records.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_class).drop("_rank")


def short_classes(records: DataFrame, per_class: int) -> DataFrame:
    return records.groupBy("class").agg(F.count("*").alias("records")).filter(F.col("records") < per_class)


def permuted_labels(records: DataFrame, label: str = "class", seed: int = 42) -> DataFrame:
    """Shuffle a label column over the rows; the label counts stay the same.

    Rows and labels are ranked in two independent hash orders and joined on the rank.
    """
    slots = rank_by_hash(records.select("id", label), [], f"slot:{seed}", name="_rank")
    labels = rank_by_hash(records.select("id", label), [], f"label:{seed}", name="_rank")
    return slots.join(labels.select("_rank", F.col(label).alias("permuted")), "_rank").select("id", label, "permuted")


def class_split_summary(records: DataFrame, group: str = "group") -> DataFrame:
    def rows_of(split):
        return F.count_if(F.col("split") == split).alias(f"{split}_records")

    return records.groupBy("class").agg(
        F.count("*").alias("records"),
        F.count_distinct(group).alias("groups"),
        rows_of("train"),
        rows_of("validation"),
        rows_of("test"),
    )
