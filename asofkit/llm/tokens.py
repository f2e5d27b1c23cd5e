"""Encoding with a public byte-level tokenizer, by forced boundaries.

A byte pair that lies inside no token of the vocabulary can be crossed by no merge, so a text may be cut there and the
pieces encoded alone. Of such cuts only those are used that the pre-tokenizer's pattern respects too: never inside a
character, after white space, or beside an apostrophe. The commonest cut, before the space of a word, makes the pieces
words, which are encoded once per task and then looked up.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the pre-tokenizer's pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KNOWN = 300_000
_LONGEST = 64
# Last bytes of white space beyond ASCII: cuts after them could change how white space is divided.
_SPACE_ENDS = sorted({c.encode()[-1] for c in map(chr, range(0x80, 0x3001)) if c.isspace()})


class Encoder:
    """One vocabulary with its table of forced boundaries."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._whole = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = forced_boundaries(ranks)
        self._known: dict[bytes, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none. Lone surrogates are read as the replacement character."""
        if not text:
            return []
        try:
            raw = text.encode()
        except UnicodeEncodeError:
            raw = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
        out: list[int] = []
        known = self._known
        for piece in self.pieces(raw):
            ids = known.get(piece)
            if ids is None:
                ids = self._whole.encode_ordinary(piece.decode())
                if len(piece) <= _LONGEST:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def pieces(self, raw: bytes) -> list[bytes]:
        b = np.frombuffer(raw, dtype=np.uint8)
        at = (np.flatnonzero(self.cut[b[:-1], b[1:]]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]


def forced_boundaries(tokens) -> np.ndarray:
    """cut[a, b]: bytes a, b lie side by side in no token, and the pattern allows the cut."""
    cut = np.ones((256, 256), dtype=bool)
    for token in tokens:
        b = np.frombuffer(token, dtype=np.uint8)
        cut[b[:-1], b[1:]] = False
    white = [i for i in range(128) if chr(i).isspace()]
    cut[white] = cut[_SPACE_ENDS] = False
    cut[:, 0x80:0xC0] = False
    cut[ord("'")] = cut[:, ord("'")] = False
    return cut


@lru_cache(4)
def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Encoder:
    return Encoder(str(Path(folder or TOKENIZERS) / f"{name}.tiktoken"))


def encoded(df: DataFrame, keys: list[str], text: str, name: str = "byte_bpe_50k", folder: str | None = None, lengths: bool = False) -> DataFrame:
    """`keys` and `ids` array<int> of each row's text, or with `lengths` only their number `n_tokens`.

    Null and empty texts give an empty list and 0. One row per input row, repeated rows too; columns of df besides the keys
    and the text don't matter. Whole texts are encoded, of any length.
    """
    kept = df.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + (", n_tokens long" if lengths else ", ids array<int>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(name, folder).encode
        for frame in frames:
            out = frame[keys].copy()
            ids = [encode(x if isinstance(x, str) else None) for x in frame["_text"]]
            out["n_tokens" if lengths else "ids"] = pd.Series([*map(len, ids)] if lengths else ids, index=out.index, dtype="int64" if lengths else object)
            yield out

    return kept.mapInPandas(run, schema)


def token_counts(text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """The number of tokens of a text, 0 for null."""

    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        encode = encoder(name, folder).encode
        return pd.Series([len(encode(x if isinstance(x, str) else None)) for x in values], dtype="int64")

    return count(text)
