"""Probability-map parsing and small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROB_MAP_TYPE = T.MapType(T.StringType(), T.DoubleType())

_JSON_OPTS = {
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowNonNumericNumbers": "false",
    "mode": "PERMISSIVE",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_prob_map(c) -> Column:
    """Python-literal or JSON dict of label -> probability; NULL if unparsable.

    One whole ``{...}`` object is required (trailing garbage is rejected by the
    guard); a trailing comma before ``}`` is accepted, as a Python dict allows.
    """
    s = F.trim(_col(c))
    cleaned = F.regexp_replace(s, ",\\s*}$", "}")
    guarded = F.when(s.rlike("(?s)^\\{.*\\}$"), cleaned)
    return last_key_wins(F.from_json(guarded, PROB_MAP_TYPE, _JSON_OPTS))


def last_key_wins(m: Column) -> Column:
    """Drop earlier duplicates of a key, as a Python dict literal does.

    ``from_json`` keeps duplicate map keys.  One fold over the entries
    rebuilds the map, each entry replacing an earlier one with its key; the
    parsed map is referenced once (a lambda that re-read it would re-parse
    the JSON per element).  A null map stays null.
    """
    empty = F.create_map().cast(PROB_MAP_TYPE)
    return F.aggregate(
        F.map_entries(m), empty,
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]),
                                    F.create_map(e["key"], e["value"])))


def decode_probs(df: DataFrame, col: str) -> Column:
    """Teacher-distribution column as a map, whatever it is stored as."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.StringType):
        return F.from_json(c, PROB_MAP_TYPE, _JSON_OPTS)
    if isinstance(dt, T.MapType):
        return c.cast(PROB_MAP_TYPE)
    if isinstance(dt, T.StructType):
        return F.from_json(F.to_json(c), PROB_MAP_TYPE)
    raise TypeError(f"cannot decode {col} of type {dt.simpleString()}")


def prob_mass(m) -> Column:
    """Σ of the map values."""
    return F.aggregate(F.map_values(_col(m)), F.lit(0.0), lambda a, x: a + x)


def keep_mass(m, min_mass: float) -> Column:
    """Predicate of the optional low-mass filter."""
    return prob_mass(m) >= F.lit(float(min_mass))


def prob_vector(m, num_labels: int, missing: str = "zero") -> Column:
    """Map -> array in label order "0".."n-1" (B18).

    ``missing='zero'`` fills absent labels with 0.0; ``'fail'`` raises.
    Extra labels are ignored and nothing is renormalised.
    """
    m = _col(m)
    items = []
    for i in range(num_labels):
        v = F.try_element_at(m, F.lit(str(i)))
        if missing == "zero":
            v = F.coalesce(v, F.lit(0.0))
        elif missing == "fail":
            v = F.when(v.isNull(), F.raise_error(F.lit(f"label {i} missing"))).otherwise(v)
        else:
            raise ValueError("missing must be 'zero' or 'fail'")
        items.append(v)
    return F.array(*items)


def probs_to_text(m) -> Column:
    """Map -> single-quoted dict text that tolerant and strict readers both parse."""
    return F.replace(F.to_json(_col(m)), F.lit('"'), F.lit("'"))


# -- names and tags (B24) ----------------------------------------------------

def run_name(path) -> Column:
    """Basename of a path."""
    return F.element_at(F.split(_col(path), "/"), -1)


def teacher_name(path) -> Column:
    """Parent-directory basename, or the basename when there is no parent."""
    parts = F.split(_col(path), "/")
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))
    return F.when(parent != "", parent).otherwise(F.element_at(parts, -1))


def teacher_size(tag) -> Column:
    """Upper-cased tag prefix before the first underscore."""
    return F.upper(F.substring_index(_col(tag), "_", 1))


def split_spec(spec) -> tuple[Column, Column]:
    """``tag:path`` split at the first colon."""
    s = _col(spec)
    return (F.regexp_extract(s, "^([^:]*):(.*)$", 1),
            F.regexp_extract(s, "^([^:]*):(.*)$", 2))


# -- sharding, batching, shuffling (B25-B27) --------------------------------

def strided_shard(idx, world_size: int) -> Column:
    """Rank of a row under strided sharding ``idx % world_size``."""
    return F.pmod(_col(idx), F.lit(world_size))


def contiguous_shard(idx, total, world_size: int) -> Column:
    """Rank under contiguous sharding: shard r holds the r-th of ``world_size``
    nearly equal blocks; the first ``total % world_size`` blocks are one longer."""
    idx, total = _col(idx), _col(total)
    base = F.floor(total / world_size)
    extra = F.pmod(total, F.lit(world_size))
    cut = extra * (base + 1)
    return F.when(idx < cut, F.floor(idx / (base + 1))) \
        .otherwise(extra + F.floor((idx - cut) / F.greatest(base, F.lit(1)))).cast("int")


def batch_id(idx, size: int) -> Column:
    """Fixed-size batch of a row: ``floor(idx / size)``."""
    return F.floor(_col(idx) / F.lit(size)).cast("long")


def shuffle_key(seed: int, *cols) -> Column:
    """Seeded order key that does not depend on partitioning."""
    return F.xxhash64(F.lit(seed), *[_col(c) for c in cols])
