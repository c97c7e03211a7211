"""Helpers shared by the training-data operators: saved tables, sizes, hashed words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import SCRATCH_DIR

#: What separates words: space and the ASCII controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temp folder; a cluster
    session raises, because a machine-local folder dies with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pairlab-llm-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """Where saved tables go: the open ``scratch_scope``, or the shared folder."""
    return spark.conf.get(SCRATCH_DIR, None) or shared_dir(spark)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back.

    Cuts the lineage: later steps read the table, and a lost executor costs a
    reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_size(docs: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, from one aggregate scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(col).cast("long")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public MurmurHash3 finaliser's constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    up = np.full(n, base & MASK64, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _block_hashes(data: np.ndarray, up: np.ndarray, down: np.ndarray,
                  letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words in a byte block."""
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[data] * up[:len(data)], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * down[starts]
    return starts, mix64(h + (ends - starts).astype(np.uint64))


def hashed_words(texts: list[str | None], lower: bool = False,
                 block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and each text's word count.

    Texts are hashed together in byte blocks with prefix sums of a polynomial
    hash, so no Python object is made for a word.  ``lower`` folds A-Z first.
    A text longer than a block gets a block of its own.
    """
    letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    up, down = powers(block)
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)

    def flush(parts: list[bytes], first: int) -> None:
        nonlocal up, down
        data = np.frombuffer(b" ".join(parts), np.uint8)
        if len(data) > len(up):
            up, down = powers(len(data))
        starts, h = _block_hashes(data, up, down, letters)
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        counts[first:first + len(parts)] = np.diff(np.searchsorted(starts, bounds))
        hashes.append(h)

    parts: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if lower:
            raw = raw.lower()
        if parts and size + len(raw) > block:
            flush(parts, first)
            parts, size, first = [], 0, i
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        flush(parts, first)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def planes(a: np.ndarray) -> bytes:
    """An integer array as byte planes: equal high bytes lie together and compress."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    n = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(n, -1).T).view(dtype).ravel()


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """Number rows from 0 in a global order, by range partitions.

    Rows are ranged over partitions, each partition numbers its own, and the
    partitions' row counts (one number each) give the offsets.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    rows = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    offsets, total = [], 0
    for part in range(max(rows, default=-1) + 1):
        offsets.append(total)
        total += rows.get(part, 0)
    before = F.element_at(F.array(*map(F.lit, offsets or [0])), F.col("_part") + 1)
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, (before + nth - 1).cast("long")).drop("_part")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tiktoken_encoding(path: str):
    """A tiktoken encoding from a ``.tiktoken`` file, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
