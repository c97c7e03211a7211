import glob
import json

import pytest
from pyspark.sql import functions as F

from pairlab.sources.sinks import write_nested_report


def document(path):
    return json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/*/part-*"))))


def test_parts_join_to_one_document(spark, tmp_path):
    summary = spark.createDataFrame([("ü \"x\"", 3, None)], "name string, n int, none double")
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.concat(F.lit("q\n\"é"), "id").alias("qid"),
                                    F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("v")).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_nested_report(summary, "per_query", rows, ("k",), str(tmp_path / "r"), drop=("k",))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = document(tmp_path / "r")
    want = [{"qid": r["qid"], "v": r["v"]} for r in sorted(rows.collect(), key=lambda r: r["k"])]
    assert got == {"name": "ü \"x\"", "n": 3, "none": None, "per_query": want}
    assert len(glob.glob(str(tmp_path / "r" / "1-body" / "part-*"))) > 1


def test_no_and_one_element_and_ties(spark, tmp_path):
    summary = spark.createDataFrame([(1,)], "a int")
    rows = spark.createDataFrame([(1, "x")], "k int, q string")
    for n in (0, 1):
        write_nested_report(summary, "list", rows.limit(n), ("k",), str(tmp_path / str(n)))
        assert document(tmp_path / str(n)) == {"a": 1, "list": [{"k": 1, "q": "x"}][:n]}
    write_nested_report(summary.limit(0), "list", rows, ("k",), str(tmp_path / "s"))
    assert document(tmp_path / "s") == {"list": [{"k": 1, "q": "x"}]}
    with pytest.raises(ValueError, match="tell elements apart"):
        write_nested_report(summary, "list", rows.union(rows), ("k",), str(tmp_path / "t"))
