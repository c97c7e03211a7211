import pytest
from pyspark.sql import functions as F

from pairlab.llm import mixing
from tests.llm.cases import no_docs, odd_docs


def by_hand(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Share, cap, share the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > limit * sizes[s]}
        if not over:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def corpus(spark, n=4000):
    """A third of the rows in one source, one source of a single row, one null source."""
    source = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id = 1 THEN 'lone' WHEN id % 10 = 1 THEN NULL ELSE concat('s', id % 5) END")
    return spark.range(n).select(F.col("id").alias("doc_id"), source.alias("source"),
                                 F.expr("repeat('w ', int(1 + id * 31 % 90))").alias("text"))


def test_targets_and_rounding(spark):
    docs = corpus(spark)
    rows = mixing.mix(docs).select("row.source", "row.doc_id", "size", "source_size", "target", "copies").collect()
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["copies"] in (0, 1, 2)
    target = by_hand(sizes)
    assert len(rows) == 4000 and {r["source"]: r["source_size"] for r in rows} == sizes
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]])
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:  # only the last open document of a source moves it off its target
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix(docs.repartition(3)).select("row.doc_id", "copies").collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in rows}


def test_expectation_over_seeds(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("concat('s', id % 3)").alias("source"),
                                  F.expr("repeat('w ', int(1 + id % 7))").alias("text"))
    taken = [mixing.mix(docs, seed=s).agg(F.sum(F.col("copies") * F.col("size"))).first()[0] for s in range(3)]
    total = docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert all(abs(t - 1.5 * total) <= 3 * 7 for t in taken)


def test_odd_and_empty_tables(spark):
    rows = mixing.mix(odd_docs(spark)).select("row.text", "row.doc_id", "size", "copies", "target").collect()
    assert len(rows) == 12 and all(r["copies"] == 0 for r in rows if r["size"] == 0)
    assert all(r["copies"] <= 2 for r in rows)
    assert mixing.mix(no_docs(spark)).count() == 0


def test_repeated_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "a b c", "t")] * 50, "doc_id long, text string, source string")
    taken = {r[0]: (r[1], r[2]) for r in mixing.mix(docs).groupBy("row.source").agg(
        F.sum(F.col("copies") * F.col("size")), F.max("target")).collect()}
    assert all(abs(t - want) <= 3 for t, want in taken.values())
