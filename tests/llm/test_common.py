import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class sparkContext:  # noqa: N801
        applicationId, master = "app-1", "spark://host:7077"

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return None


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Elsewhere, "x")
    Elsewhere.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Elsewhere, "x")
    assert common.shared_dir(spark, "x") != common.shared_dir(spark, "x")


def folder(frame):
    return os.path.dirname(frame.inputFiles()[0]).removeprefix("file://")


def test_tables_are_noted_and_removed_unless_read(spark):
    with common.noted() as paths:
        a = common.materialize(spark.range(5).toDF("x"), "a")
        with common.noted() as inner:
            b = common.materialize(spark.range(7).toDF("x"), "b")
    assert len(paths) == 1 and len(inner) == 1
    at = folder(b)
    kept = common.remove(spark, [*paths, *inner], a.where("x > 1").withColumn("y", F.lit(1)))
    assert kept == paths and a.count() == 5 and not os.path.exists(at)
    assert common.remove(spark, paths) == [] and not os.path.exists(folder_of(paths[0]))


def folder_of(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_stages_tidy_up_after_each_other(spark, docs):
    """Written between stages, nothing of an earlier stage is left; chained without writing, nothing that is read goes."""
    now, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = common.materialize(stage(spark, now, ""), "test-tidy")
        left.append(list(corpus_pipeline._left[spark.sparkContext.applicationId]))
    assert left[1] and left[2] and not any(os.path.exists(folder_of(p)) for p in [*left[0], *left[1]]) and any(os.path.exists(folder_of(p)) for p in left[2])
    chained = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        chained = stage(spark, chained, "")
    assert sorted(r.doc_id for r in chained.collect()) == sorted(r.doc_id for r in now.collect())


def test_blocks_of_prefix_sums(spark):
    rows = spark.createDataFrame([(k % 2, 3 * k, k) for k in range(50)], "g long, key long, n long")
    got = {(r.g, r.key): r.base for r in common.prefix_base(rows, "key", "n", ["g"], width=16).collect()}
    assert got == {(k % 2, 3 * k): sum(j for j in range(k) if j % 2 == k % 2) for k in range(50)}
