"""Findings of the fourth round: what was slow or wrong, on rows made here."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessella.operators import boosting
from tessella.operators.boosting import SUMS, STACKED, Boosting, SecondOrderBoosting, Tree, gradients, level_sums


@pytest.mark.parametrize("objective, base", [("squared", [0.5]), ("logistic", [0.25]), ("softmax", [0.0, 0.5, -0.25])])
def test_stacks_have_the_sums_of_their_rows(spark, objective, base):
    """Bins, gradients and sums of stored stacks are those of plain rows, unknown labels and odd values included."""
    x = [F.when(F.col("id") % 7 == 3, float("nan")).otherwise(F.col("id") % 7), F.col("id") * 5 % 11 * 1.0, F.when(F.col("id") % 2 == 0, -0.0).otherwise(1.0)]
    y = F.when(F.col("id") % 9 != 4, F.col("id") % len(base) if objective == "softmax" else F.col("id") % 2).cast("double")
    rows = spark.range(0, 500, 1, 3).select(y.alias("y"), F.array(*x).alias("x"))
    cuts = [[2.0, 5.0], [1.0, 4.0, 6.5], [0.0]]
    stacks = rows.mapInArrow(boosting._stacks(cuts, base, objective), STACKED)
    assert stacks.count() == 3
    bins = F.array(*[sum((F.get("x", F.lit(i)) >= c).cast("int") for c in own) for i, own in enumerate(cuts)])
    plain = rows.select(bins.alias("bins"), gradients(objective, F.array(*map(F.lit, base)), F.col("y"), len(base)).alias("gh"), F.array(*[F.lit(0)] * len(base)).alias("nodes"))
    cells = F.transform("gh", lambda c: F.struct(F.coalesce(c["g"], F.lit(0.0)).alias("g"), F.coalesce(c["h"], F.lit(0.0)).alias("h")))
    trees = [Tree([-1], [0.0], [0.0], [0.0])] * len(base)
    read = boosting._reader(objective, boosting._bin_type(cuts), 3, len(base))
    parts = stacks.mapInArrow(boosting._task_sums(trees, [[0]] * len(base), 0, 4, 3, read), SUMS)
    sums = lambda df: {tuple(r[:4]): r[4:] for r in df.groupBy("class", "node", "feature", "bin").agg(F.sum("g"), F.sum("h")).collect()}
    found, want = sums(parts), sums(level_sums(plain.withColumn("gh", cells)))
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_features_with_many_bins_are_added_up_one_by_one(spark, monkeypatch):
    """Pairs of features give the sums and trees that single ones give."""
    rows = spark.range(400).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") * 7 % 31).cast("double").alias("b"), (F.col("id") % 5).cast("double").alias("c"), (F.col("id") % 17).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    found = [SecondOrderBoosting(3, 0, Boosting(2, 3)).fit(rows).trees]
    monkeypatch.setattr(boosting, "PAIRED", 1)
    found.append(SecondOrderBoosting(3, 0, Boosting(2, 3)).fit(rows).trees)
    one, other = ([t for own in trees for t in own] for trees in found)
    assert [t.feature for t in one] == [t.feature for t in other] and [t.cut for t in one] == [t.cut for t in other]
    assert all(a.weight == pytest.approx(b.weight) for a, b in zip(one, other))


def test_levels_of_boosting_read_stacks_and_not_rows(spark, monkeypatch):
    """a level reads a row for each stack, and each round stores as many."""
    stored, plain = [], boosting._stored
    monkeypatch.setattr(boosting, "STACK", 64)

    def seen(rows):
        table, path = plain(rows)
        stored.append(table.count())
        return table, path

    monkeypatch.setattr(boosting, "_stored", seen)
    rows = spark.range(0, 1000, 1, 2).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 17).cast("double").alias("label"))
    model = SecondOrderBoosting(1, 0, Boosting(3, 2)).fit(VectorAssembler(inputCols=["a"], outputCol="features").transform(rows))
    assert len(stored) == len(model.trees) == 3 and all(n <= 1000 // 64 + 2 for n in stored)
    assert np.isfinite([t.weight for own in model.trees for t in own]).all()



def test_a_task_holds_few_stacks(spark, monkeypatch):
    """row groups are small, as a task holds one whole; before, 100 stacks or 128 MB at least."""
    monkeypatch.setattr(boosting, "GROUP_BYTES", 1 << 18)
    monkeypatch.setattr(boosting, "STACK", 1 << 12)
    rows = spark.range(0, 200_000, 1, 1).select(F.rand(1).alias("y"), F.array(F.rand(2), F.rand(3)).alias("x"))
    table, path = boosting._stored(rows.mapInArrow(boosting._stacks([[0.3, 0.6], [0.5]], [0.0], "squared"), STACKED))
    assert table.count() == -(-200_000 // 4096)
    found = [pq.ParquetFile(f).metadata for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    boosting.remove(spark, path)
    assert max(m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)) < 1 << 19
