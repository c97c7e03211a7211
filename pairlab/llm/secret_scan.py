"""Secret scans by token efficiency (operator 8).

Random strings compress badly under a byte-pair vocabulary trained on text: a
key yields about two characters per token, a word or an identifier three or
more.  A candidate is a long unbroken run of key characters; it is excluded
when it is a known digest (hexadecimal at a digest's length), a UUID, or a ruler
(more than a quarter of it are separators in front).  Separators in front of a
run are not looked at, but belong to its span, as a key may begin with them.
A run shaped like an identifier (pieces of one case, or capitalised, with numbers
apart) says nothing by its separators and numbers, so its letters are judged in
lower case: each piece of ``PIECE_LETTERS`` or more, and the pieces together where
they have ``RUN_LETTERS``; it is a secret of kind ``token`` where one of them has
fewer than ``PIECE_RATIO`` characters per token.  Any other run is one below
``MIN_RATIO``; words come closer to it than whole runs do.  Three fixed patterns
(``assign``, ``access``, ``hex``) find declared secrets beside it; their spans
always stay.  All patterns take time in proportion to the text.

Defined results: a null or empty text has no spans; offsets count code points,
ends are exclusive; spans of different kinds may overlap, a ``token`` span
inside a base span is not repeated.  Texts are scanned whole at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tiktoken_encoding, tokenizer_path

KINDS = ("assign", "access", "hex", "token")
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_RATIO = 2.3  # characters per token
PIECE_RATIO = 2.0  # the same for the letters of identifiers
PIECE_LETTERS, RUN_LETTERS = 12, 16
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
SEPARATORS = "-_/+="
#: One piece of an identifier; possessive, so that no run is split in more than one way.
PIECE = r"(?:[A-Z]?+[a-z]++|[A-Z]++)[0-9]{0,4}+|[0-9]++"
IDENTIFIER = rf"(?:{PIECE})(?:[-_/+=]++(?:{PIECE}))*+[-_/+=]*+"
CAMEL = r"(?:[A-Z]?+[a-z]{2,}+){1,6}+[0-9]{0,4}+"
LETTERS = r"[A-Z]?+[a-z]++|[A-Z]++"

RESULT = "spans array<struct<start:int,kind:int,end:int>>, masked string"
MASK = "[SECRET]"


def _scanner(vocabulary: str, min_ratio: float):
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re
        from bisect import bisect_right
        from itertools import accumulate

        encoding = tiktoken_encoding(vocabulary)
        assign, access, hexes = (re.compile(p, re.ASCII) for p in (ASSIGN, ACCESS, HEX))
        run, uuid, name, camel, letters = (re.compile(p, re.ASCII) for p in (RUN, UUID, IDENTIFIER, CAMEL, LETTERS))

        def random_looking(s: str) -> bool:
            whole, s = len(s), s.lstrip(SEPARATORS)
            if 4 * len(s) < 3 * whole:
                return False
            if uuid.fullmatch(s) or len(s) in DIGEST_LENGTHS and all(c in "0123456789abcdefABCDEF" for c in s):
                return False
            if not name.fullmatch(s):
                return not camel.fullmatch(s) and len(s) < min_ratio * len(encoding.encode_ordinary(s))
            pieces = [x.lower() for x in letters.findall(s)]
            tokens = [len(encoding.encode_ordinary(x)) for x in pieces]
            limit, n = min(min_ratio, PIECE_RATIO), sum(map(len, pieces))
            return (n >= RUN_LETTERS and n < limit * sum(tokens)
                    or any(len(x) >= PIECE_LETTERS and len(x) < limit * k for x, k in zip(pieces, tokens)))

        def spans(text: str | None) -> list[tuple[int, int, int]]:
            if not text:
                return []
            found = []
            if "=" in text or ":" in text:  # each assignment has one of them
                found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_MIN]
            runs = list(run.finditer(text))  # access and hex matches lie inside such a run
            for m in runs:
                for kind, pattern in ((1, access), (2, hexes)):
                    found += [(m.start() + x.start(), kind, m.start() + x.end()) for x in pattern.finditer(m[0])]
            base = sorted(found)
            starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max, initial=-1))
            found += [(m.start(), 3, m.end()) for m in runs
                      if reach[bisect_right(starts, m.start())] < m.end() and random_looking(m[0])]
            return sorted(found)

        def masked(text: str, found: list[tuple[int, int, int]]) -> str:
            parts, at = [], 0
            for start, _, end in found:
                if start >= at:  # else it overlaps the stretch before it
                    parts += [text[at:start], MASK]
                at = max(at, end)
            return "".join(parts) + text[at:]

        for texts in batches:
            found = [spans(t) for t in texts]
            yield pd.DataFrame({"spans": found, "masked": [masked(t, f) if f else None for t, f in zip(texts, found)]})
    return scan


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``row, spans, masked`` per row of ``docs``; ``row`` is the row itself.

    ``spans`` holds ``start, kind (an index of KINDS), end`` by start and kind;
    ``masked`` is the text with each stretch of spans replaced by ``MASK``, or
    null where there are no spans.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scan = F.pandas_udf(_scanner(vocabulary or tokenizer_path("byte_bpe_50k.tiktoken"), min_ratio), RESULT)
    return docs.select(row, scan(F.col("text")).alias("found")).select("row", "found.spans", "found.masked")
