r"""Chat formatting of reply trees (operator 2).

Messages with a parent form a tree per conversation.  Root-to-leaf paths come
from self-joins that double their reach: after k joins every message knows the
ancestor 2**k above it, its depth and the summed score on the way, so a tree of
depth D takes log2(D) joins of narrow rows.  Leaves are ranked by their path's
score; the kept leaves collect their ancestors by walking the same pointers
down from the longest, and each path becomes one formatted conversation.

The template is ``<|im_start|>role\ntext<|im_end|>\n``.  In roles and texts a
backslash is doubled, and a control string gets a backslash after its first
character, so none survives; ``unescape`` drops each backslash before a
character.  Loss spans cover the assistants' escaped texts, without markers.

Defined results: a null text or role is empty; a null conversation id is one
conversation; rows that repeat a message id are one message (the least parent,
score, role and text); a message without an id has no replies and gets its
content's hash as id, so that equal ones under one parent are one message; a
missing parent makes a root; a message that hangs on a
cycle loses its parent link; equal scores go to the smaller leaf id; an empty
table gives an empty result.  One conversation is one output row, whatever its
length.  Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

FORMATTED = "formatted string, loss_spans array<struct<start:long,end:long>>"
READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return re.sub("|".join(map(re.escape, CONTROL)), lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """A conversation's text and the spans of it that are trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


_TURN = r"<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*?)<\|im_end\|>\n"


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in re.finditer(_TURN, formatted, re.DOTALL)]


def _rendered(turns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in turns:
        done = [render([(t["role"], t["text"]) for t in conversation]) for conversation in batch]
        yield pd.DataFrame(done, columns=["formatted", "loss_spans"])


def _read_back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for texts, all_spans in batches:
        rows = []
        for formatted, spans in zip(texts, all_spans):
            turns = read(formatted)
            loss = "".join(unescape(formatted[s["start"]:s["end"]]) for s in spans)
            rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss),
                         len(formatted)))
        yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _same(a: str, b: str, id_a: str = "id", id_b: str = "id"):
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{id_a}") == F.col(f"{b}.{id_b}"))


def _pointers(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestor pointers by doubling, and ``conv_id, id, depth, score`` of each message's path.

    ``links`` has ``conv_id, id, up (parent or null), score``.
    """
    longest = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    state = links.select("conv_id", "id", "up", F.lit(0).cast("long").alias("depth"), "score",
                         F.col("score").alias("total"))
    state = state.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long"))
    jumps = []
    for _ in range(math.ceil(math.log2(longest + 1)) + 1):
        state = saved(state)
        if not state.filter("up IS NOT NULL").head(1):
            return jumps, state.select("conv_id", "id", "depth", F.col("total").alias("score"))
        below = state.filter("up IS NOT NULL")  # messages at a root are done
        jumps.append(below.select("conv_id", "id", "up"))
        longer = below.alias("s").join(state.alias("p"), _same("s", "p", "up")).select(
            "s.conv_id", "s.id", F.col("p.up").alias("up"), (F.col("s.depth") + F.col("p.depth")).alias("depth"),
            "s.score", (F.col("s.total") + F.col("p.total")).alias("total"))
        state = state.filter("up IS NULL").unionByName(longer)
    hung = saved(state.filter("up IS NOT NULL").select("conv_id", "id"))  # on a cycle, or below one
    cut = links.alias("l").join(hung.alias("h"), _same("l", "h"), "left").select(
        "l.conv_id", "l.id", F.when(F.col("h.id").isNull(), F.col("l.up")).alias("up"), "l.score")
    return _pointers(saved(cut))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``conv_id, branch, turn, role, text`` of the best ``branches`` paths per conversation.

    ``messages`` has ``conv_id, id, parent, role, text, score``.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
                   F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    made = F.xxhash64("conv_id", F.lit("id"), "parent", row).cast(messages.schema["id"].dataType)
    named = messages.withColumn("id", F.coalesce("id", made))
    nodes = saved(named.groupBy("conv_id", "id").agg(F.min(row).alias("m")).select("conv_id", "id", "m.*"))
    ids = nodes.select("conv_id", "id")
    links = saved(nodes.alias("n").join(ids.alias("p"), _same("n", "p", "parent"), "left").select(
        "n.conv_id", "n.id", F.when(F.col("p.id") != F.col("n.id"), F.col("p.id")).alias("up"), "n.score"))
    jumps, paths = _pointers(links)
    paths = saved(paths)
    # leaves: nobody's parent, once cycles are cut (the first pointers are the links that hold)
    parents = (jumps[0] if jumps else links.filter("false")).select("conv_id", F.col("up").alias("id")).distinct()
    leaves = paths.alias("m").join(parents.alias("p"), _same("m", "p"), "left_anti")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("score").desc(), "id"))
    on_path = leaves.withColumn("branch", rank).filter(F.col("branch") <= branches).select("conv_id", "branch", "id")
    for jump in reversed(jumps):  # every distance to an ancestor is one sum of the jumps
        on_path = saved(on_path)
        above = on_path.alias("o").join(jump.alias("j"), _same("o", "j")).select(
            "o.conv_id", "o.branch", F.col("j.up").alias("id"))
        on_path = on_path.unionByName(above)
    placed = on_path.alias("o").join(paths.alias("m"), _same("o", "m")).select("o.conv_id", "o.branch", "o.id", "m.depth")
    return placed.alias("o").join(nodes.alias("n"), _same("o", "n")).select(
        "o.conv_id", "o.branch", F.col("o.depth").alias("turn"), "n.role", "n.text")


def format_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, branch, formatted, loss_spans`` of each path."""
    listed = turns.groupBy("conv_id", "branch").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    texts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    made = F.pandas_udf(_rendered, FORMATTED)(texts)
    # a generator, so that the function runs once for both of its columns
    return listed.select("conv_id", "branch", F.inline(F.array(made)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the output."""
    return formatted.select("conv_id", "branch", F.inline(F.array(
        F.pandas_udf(_read_back, READ)("formatted", "loss_spans"))))


def chain(rows: DataFrame) -> DataFrame:
    """Messages of conversations that are lists: each row replies to the one before it.

    ``rows`` has ``conv_id, turn, role, text``; equal turns go by role and text.
    """
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.select("conv_id", place.alias("id"), "role", "text")
    return numbered.select("conv_id", "id", (F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
