import os

import pytest
from pyspark.sql import functions as F

from pairlab.operators import fullrank
from pairlab.session import SCRATCH_DIR, ensure_checkpoint_dir, materialized, scratch_scope


def local(path):
    return path.removeprefix("file:")


def test_saved_tables_go_with_their_scope(spark):
    df = spark.range(100).select(F.col("id").alias("global_idx"), (F.col("id") % 3).alias("qid"), F.rand(1).alias("score"))
    kept = materialized(df, "kept")
    with scratch_scope(spark) as outer:
        assert outer.startswith(ensure_checkpoint_dir(spark))
        ranked = fullrank.full_rank(df)
        with scratch_scope(spark) as inner:
            assert inner.startswith(outer)
            assert materialized(df, "inner").count() == 100 and os.listdir(local(inner))
        assert not os.path.exists(local(inner)) and spark.conf.get(SCRATCH_DIR) == outer
        assert ranked.count() == 100 and os.listdir(local(outer))
    assert not os.path.exists(local(outer)) and spark.conf.get(SCRATCH_DIR, None) is None
    assert kept.count() == 100


def test_a_failing_job_leaves_nothing(spark):
    with pytest.raises(RuntimeError):
        with scratch_scope(spark) as path:
            materialized(spark.range(3), "t")
            raise RuntimeError
    assert not os.path.exists(local(path))
