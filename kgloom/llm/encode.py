"""Exact byte-pair encoding of a corpus in linear time (problem 7).

A text is cut by the vocabulary's public split pattern; each piece is encoded by a
backtracking encoder: an Aho-Corasick automaton over all tokens gives the longest token at a
position, a pair-compatibility test against the merge table rejects neighbours that the
merges would have joined otherwise, and a rejected token falls back to its longest proper
prefix token. Each position is left for good after a bounded number of steps (a bitmap
marks the dead ones), so the time is linear in the bytes. Decoding slices one byte blob by
an offset table.

Defined results: a null text gives null ids, an empty text gives an empty list; repeated
rows give repeated rows. The vocabulary is read on the executors from `path` (a parameter;
by default the installed public tokenizers). It has a fixed size, so nothing broadcast
grows with the data.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.session import spread

#: Distinct pieces whose ids a Python worker remembers, and the longest piece it keeps.
MEMO, MEMO_BYTES = 200_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a vocabulary file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class BacktrackingEncoder:
    """Byte-level BPE with ids in order of merge rank."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.split = regex.compile(pattern)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        # texts are matched as latin-1 strings, one character a byte
        names = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in names.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.length = [0] * self.size
        blob, self.offsets = [], [0] * (self.size + 1)
        for i, t in sorted((i, t) for t, i in ranks.items()):
            self.length[i] = len(t)
            blob.append(t)
            self.offsets[i + 1] = self.offsets[i] + len(t)
        self.blob = b"".join(blob)
        self.names = names
        self.longest = max(self.length)
        # longest proper prefix that is a token
        self.prefix = [-1] * self.size
        for t, i in names.items():
            for k in range(len(t) - 1, 0, -1):
                if (p := names.get(t[:k])) is not None:
                    self.prefix[i] = p
                    break
        # the pair whose merge makes a token: found by encoding it with the tokens before it
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.joined: dict[tuple[int, int], int] = {}
        for i, t in sorted((i, t) for t, i in names.items()):
            if len(t) == 1:
                continue
            for k in range(1, len(t)):
                a, b = names.get(t[:k]), names.get(t[k:])
                if a is not None and b is not None and a < i and b < i and self.compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.joined[a, b] = i
                    break
        self.memo: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side when their bytes meet."""
        joined, left, right = self.joined, self.left, self.right
        limit = 1 << 60
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = right[a]
                if a != limit:
                    continue
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 != limit:
                    continue
                limit = a
                a = right[a]
                if a == limit:
                    return True

    def encode_bytes(self, s: str) -> list[int]:
        """Ids of one piece, given as latin-1 string of its bytes."""
        whole = self.names.get(s)
        if whole is not None and self.length[whole] > 1 and self.left[whole] == whole:
            whole = None  # a token that no merge makes
        if whole is not None:
            return [whole]
        out: list[int] = []
        n, pos = len(s), 0
        dead = bytearray(n + 1)
        first, length, prefix, compatible = self._first, self.length, self.prefix, self.compatible
        token = first(s, 0)
        while token >= 0:
            end = pos + length[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                pos = end
                token = first(s, pos) if pos < n else -1
            elif prefix[token] >= 0:
                token = prefix[token]
            else:  # nothing fits here: take back the last token and try its prefix
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]
                # the token taken back ended at a dead place now, so its prefix is tried
        return out

    def _first(self, s: str, pos: int) -> int:
        """The longest token that starts at pos; the automaton sees no more than a token's length."""
        for _, token in self.automaton.iter_long(s[pos : pos + self.longest]):
            return token
        return -1

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for piece in self.split.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode("utf-8", "replace").decode("latin-1"))
                if len(piece) <= MEMO_BYTES and len(memo) < MEMO:
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        blob, at = self.blob, self.offsets
        return b"".join([blob[at[i] : at[i + 1]] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> BacktrackingEncoder:
    """One encoder for each vocabulary in a Python worker."""
    return BacktrackingEncoder(path)


def encode_udf(path: str, counts: bool = False) -> Column:
    """text -> ids, or their number."""
    out = T.IntegerType() if counts else T.ArrayType(T.IntegerType())

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            if counts:
                yield pd.Series([None if t is None else len(e.encode(t)) for t in texts], dtype="Int32")
            else:
                yield pd.Series([None if t is None else e.encode(t) for t in texts], dtype=object)

    return run


def decode_udf(path: str) -> Column:
    """ids -> text."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for ids in batches:
            yield pd.Series([None if i is None else e.decode(list(i)) for i in ids], dtype=object)

    return run


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row; no shuffle beyond one that fills idle cores."""
    return spread(documents.select("doc_id", "text")).select("doc_id", encode_udf(path or vocabulary_path())("text").alias("ids"))


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row (0 for an empty text, null for none)."""
    return spread(documents.select("doc_id", "text")).select("doc_id", encode_udf(path or vocabulary_path(), counts=True)("text").alias("n_tokens"))


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, number of ids and whether decoding them gives the text again (null for no text); for whole rows, without a shuffle."""
    path = path or vocabulary_path()
    ids = spread(documents.select("doc_id", "text")).select("doc_id", "text", encode_udf(path)("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_ids"), (decode_udf(path)("ids") == F.col("text")).alias("same"))
