import csv
import random

import pytest

from pairlab.sources import quoted
from pairlab.sources.lines import with_positions
from pairlab.sources.scores import read_score_rows, read_scores


@pytest.fixture()
def tiny_splits(spark):
    """Splits of a few bytes, so that records cross them."""
    names = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def rows_of(seed, n):
    draw = random.Random(seed)

    def text():
        return "".join(draw.choices(['"', "\n", "\t", "a", "bc", "é", "'", '""', ",", " "], k=draw.randrange(30)))
    return [(str(i), "{'0': 0.5, '1': 0.5}", text() or "x", str(i / 8)) for i in range(n)]


HEADER = ("global_idx", "all_digit_scores", "output_texts", "weighted_scores")


def write(path, rows, header=HEADER, newline="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, delimiter="\t", lineterminator=newline)
        w.writerows([header, *rows])
    return str(path)


def python_rows(path):
    with open(path, newline="") as f:
        rows = [r for r in csv.reader(f, delimiter="\t") if r]
    return [dict(zip(rows[0], r)) for r in rows[1:]]


def test_end_state_is_a_readers():
    draw = random.Random(1)
    for _ in range(3000):
        line = "".join(draw.choices(['"', '""', "a", "\t"], k=draw.randrange(9)))
        for state in (0, 1):
            # by hand, character by character
            s, start, i = state, not state, 0
            while i < len(line):
                c = line[i]
                if s:
                    if c == '"' and line[i + 1:i + 2] == '"':
                        i += 1
                    elif c == '"':
                        s, start = 0, False
                elif c == "\t":
                    start = True
                else:
                    s, start = int(start and c == '"'), False
                i += 1
            assert quoted.end_state(line, state) == s, (line, state)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_rows_equal_a_sequential_readers(spark, tmp_path, tiny_splits, newline):
    path = write(tmp_path / "s.tsv", rows_of(3, 300), newline=newline)
    want = python_rows(path)
    raw = read_score_rows(spark, path)
    assert raw.rdd.getNumPartitions() > 50
    got = with_positions(raw, path).orderBy("global_idx").collect()
    columns = ("global_idx", "all_digit_scores", "output_texts", "weighted_scores")
    assert len(got) == len(want) == 300
    at = raw.orderBy("block_start", "seq").collect()
    for r, w in zip(at, want):
        assert (r["global_idx"], r["output_texts"]) == (int(w["global_idx"]), w["output_texts"]), w
        assert r["weighted_scores"] == float(w["weighted_scores"]) and r["all_digit_scores"] == w["all_digit_scores"]
    assert [r["global_idx"] for r in got] == list(range(300)) and set(columns) <= set(raw.columns)


def test_positions_number_records_not_lines(spark, tmp_path, tiny_splits):
    one, two = (write(tmp_path / f"{k}.tsv", rows_of(k, 60)) for k in (1, 2))
    rows = read_score_rows(spark, [two, one], columns=(("output_texts", "string", True),))
    got = [r["output_texts"] for r in with_positions(rows, [two, one]).orderBy("global_idx").collect()]
    assert got == [w["output_texts"] for p in (two, one) for w in python_rows(p)]


def test_part_files_with_other_headers(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    write(d / "part-0.tsv", rows_of(1, 20))
    write(d / "part-1.tsv", [(r[3], r[2], r[0], r[1]) for r in rows_of(2, 20)], (HEADER[3], HEADER[2], HEADER[0], HEADER[1]))
    write(d / "part-2.tsv", [(f"k{r[0]}", r[0], r[1]) for r in rows_of(3, 20)], ("extra", HEADER[0], HEADER[1]))
    rows = read_score_rows(spark, str(d)).collect()
    assert len(rows) == 60 and all(r["all_digit_scores"] == "{'0': 0.5, '1': 0.5}" for r in rows)
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file_path"][-5], []).append(r)
    assert all([x["global_idx"] for x in sorted(v, key=lambda x: x["seq"])] == list(range(20)) for v in by_file.values())
    assert all(r["weighted_scores"] is None and r["output_texts"] is None for r in by_file["2"])
    write(d / "part-3.tsv", [("1",)], ("nothing",))
    with pytest.raises(ValueError, match="lacks column"):
        read_score_rows(spark, str(d))


def test_odd_files(spark, tmp_path, tiny_splits):
    p = tmp_path / "odd.tsv"
    p.write_text('\n"global_idx"\tall_digit_scores\toutput_texts\n\n0\t{}\ta "quoted" word\n\r\n1\t{}\t"open\nto the end\n')
    rows = {r["global_idx"]: r["output_texts"] for r in read_score_rows(spark, str(p)).collect()}
    assert rows[0] == 'a "quoted" word' and rows[1].startswith("open\nto the end") and len(rows) == 2
    long = tmp_path / "long.tsv"
    write(long, [("0", "{}", "x\n" * 2000, "1"), ("1", "{}", "y", "2")])
    rows = {r["global_idx"]: r["output_texts"] for r in read_score_rows(spark, str(long)).collect()}
    assert rows == {0: "x\n" * 2000, 1: "y"}
    assert read_scores(spark, write(tmp_path / "none.tsv", [])).count() == 0
