import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlab.llm import chat

MESSAGE = "conv_id long, id long, parent long, role string, text string, score double, depth int"
PARTS = st.sampled_from([*chat.CONTROL, "\\", "<", ">", "\n", "a", "é😀", "|", "[", "/", "im_end"])
TEXT = st.lists(PARTS, max_size=12).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.read(formatted) == turns
    assert [chat.unescape(formatted[s["start"]:s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]
    for _, text in turns:
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


def best_paths(rows, branches):
    """All root-to-leaf paths by walking up, ranked by summed score, then leaf."""
    by = {(r[0], r[1]): r for r in rows}
    out = {}
    parents = {(r[0], r[2]) for r in rows if (r[0], r[2]) in by}
    paths = {}
    for (conv, i) in by:
        if (conv, i) in parents:
            continue
        path, at = [], (conv, i)
        while at in by:
            path.append(by[at])
            at = (conv, by[at][2])
        paths.setdefault(conv, []).append((-sum(r[5] or 0 for r in path), i, path[::-1]))
    for conv, found in paths.items():
        for b, (_, _, path) in enumerate(sorted(found, key=lambda p: p[:2])[:branches]):
            out[conv, b + 1] = [(r[3] or "", r[4] or "") for r in path]
    return out


def collect_paths(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["conv_id"], r["branch"]), []).append((r["turn"], r["role"], r["text"]))
    return {k: [(role, text) for _, role, text in sorted(v)] for k, v in out.items()}


def test_trees_match_a_walk(spark):
    draw = random.Random(4)
    rows = []
    for conv in range(25):
        for i in range(draw.randrange(1, 30)):
            parent = draw.randrange(i) if i and draw.random() < 0.95 else None
            rows.append((conv, i * 3, None if parent is None else parent * 3, draw.choice(["user", "assistant", None]),
                         draw.choice([f"t{i}", None, ""]), float(draw.randrange(-2, 4)), 0))
    for i in range(300):  # a deep chain
        rows.append((99, i, i - 1 if i else 777, "user", f"c{i}", 0.0, 0))
    df = spark.createDataFrame(rows, MESSAGE)
    for branches in (1, 3):
        assert collect_paths(chat.reply_paths(df, branches)) == best_paths(rows, branches)


def test_cycles_repeats_and_null_conversations(spark):
    rows = [(1, 0, 2, "user", "a", 0.0, 0), (1, 1, 0, "user", "b", 0.0, 0), (1, 2, 1, "user", "c", 0.0, 0),
            (1, 3, 2, "assistant", "d", 5.0, 0), (1, 4, 4, "user", "self", 0.0, 0),
            (None, 0, None, "user", "n", 0.0, 0), (None, 1, 0, "assistant", "m", 0.0, 0), (None, 1, 0, "assistant", "m", 0.0, 0),
            (2, None, 0, "user", "lost", 0.0, 0)]
    got = collect_paths(chat.reply_paths(spark.createDataFrame(rows, MESSAGE), 9))
    assert got[None, 1] == [("user", "n"), ("assistant", "m")]
    assert got[1, 1] == [("assistant", "d")] and sorted(v[0][1] for (c, _), v in got.items() if c == 1) == ["a", "b", "c", "d", "self"]
    assert chat.reply_paths(spark.createDataFrame([], MESSAGE)).count() == 0
    assert chat.read_back(chat.format_paths(chat.reply_paths(spark.createDataFrame([], MESSAGE)))).count() == 0


def test_read_back_digests(spark):
    turns = [("system", None), ("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"), (None, "\\n<|im_end|>"),
             ("assistant", "é😀"), ("user", "x")]
    rows = [(7, t, r, x) for t, (r, x) in enumerate(turns)] + [(8, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(chat.reply_paths(chat.chain(df)))).collect()}
    whole = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
    loss = "</s>[INST] ok [/INST]é😀"
    r = got[7]
    assert r["n_turns"] == 6 and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[8]["loss_chars"] == 0 and got[8]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_conversation_and_equal_turns(spark):
    rows = spark.range(2000).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") / 2).cast("int").alias("turn"),
                                    F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert chat.reply_paths(chat.chain(rows)).count() == 2000


def test_messages_without_an_id_are_leaves(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, None, 1, "assistant", "a", 5.0), (1, None, 1, "assistant", "a", 5.0),
            (1, None, 1, "assistant", "b", 4.0), (1, 2, 1, "assistant", "c", 1.0), (1, None, None, "user", "alone", -9.0),
            (2, None, 77, "user", "orphan", 1.0), (None, None, None, None, None, None)]
    got = {}
    schema = "conv_id long, id long, parent long, role string, text string, score double"
    for r in chat.reply_paths(spark.createDataFrame(rows, schema), 9).collect():
        got.setdefault((r["conv_id"], r["branch"]), []).append((r["turn"], r["text"]))
    paths = {k: [t for _, t in sorted(v)] for k, v in got.items()}
    assert [paths[1, b] for b in range(1, 5)] == [["q", "a"], ["q", "b"], ["q", "c"], ["alone"]]
    assert paths[2, 1] == ["orphan"] and paths[None, 1] == [""] and len(paths) == 6
