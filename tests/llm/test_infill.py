import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pairlab.llm import infill, queries
from pairlab.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import no_docs, odd_docs


def by_hand(doc_id, text, units):
    """Form, cut lengths in units and output; ``units`` are the text's pieces."""
    text, n = text or "", len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def unit_list(pattern, text):
    """A gap belongs to the unit behind it, the end of the text to the last one."""
    ends = [m.end() for m in re.finditer(pattern, text or "") if m.end() > m.start()]
    if not ends:
        return []
    ends[-1] = len(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


WIDE = "aé北😀"


def check(docs, unit=None):
    rows = infill.fill_in_middle(docs, unit).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["row"]["text"] or ""
        want = by_hand(r["row"]["doc_id"], text, unit_list(unit, text) if unit else list(text))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == text
    return rows


def test_every_cut_matches_a_plain_version(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices(WIDE, k=draw.randrange(0, 3000))) for _ in range(200)]
    texts += ["x" * 3_000_000, "北" * 400_000 + "x" * 400_000 + WIDE * 200_000, "a <P> b", "<S", "<M>", "<<<P", "S><S", "><", "\0\n"]
    texts += ["".join(draw.choices("<>PSM", k=9)) for _ in range(300)]
    forms = {r["form"] for r in check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    assert forms == {"plain", "psm", "spm"}


def test_units_of_a_pattern(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices(WIDE + "  \n", k=draw.randrange(0, 300))) for _ in range(100)] + ["", "   ", " a ", "é  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for unit in (r"\S+", r"\s*\S+", r"(?s).", r"[^\n]*\n?"):
        check(docs, unit)


def test_segments_keep_their_error_bound():
    draw = np.random.default_rng(3)
    widths = [np.ones(5000, int), draw.integers(1, 5, 20_000), np.repeat(draw.integers(1, 5, 40), 300),
              draw.integers(1, 4000, 500), np.zeros(0, int), np.array([7])]
    for error in (1, 10, 120):
        for w in widths:
            offsets = np.cumsum(w)
            first, base, slope = infill.fit_segments(offsets, error)
            s = np.searchsorted(first, np.arange(len(w)), side="right") - 1
            assert (np.abs(base[s] + slope[s] * (np.arange(len(w)) - first[s]) - offsets) <= error + 1e-6).all()
            index = infill.RankIndex(error)
            for part in np.array_split(offsets, 3):
                index.add(part)
            assert (index.close().offsets(np.arange(len(w))) == offsets).all()
    assert len(infill.fit_segments(np.arange(100_000))[0]) == 1


def test_batches_and_blocks_do_not_matter(spark, monkeypatch):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    want = sorted(map(str, infill.fill_in_middle(docs).collect()))
    monkeypatch.setattr(infill, "BLOCK", 77)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, infill.fill_in_middle(docs.repartition(3)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_and_empty_tables(spark):
    rows = check(odd_docs(spark))
    assert {r["row"]["rank"] for r in rows} == set(range(12))
    assert infill.fill_in_middle(no_docs(spark)).count() == 0


def test_query_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF001, "documents").collect()}
    rows = queries.op11_fill_in_middle(spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(by_hand(r["doc_id"], text, list(text))[4].encode()).hexdigest()
