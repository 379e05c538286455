"""Byte-level BPE by backtracking over longest matches.

A token sequence is the one that the merges give exactly if each two neighbours are compatible,
that is, if merging those two tokens' bytes from scratch gives just these two. So a piece is encoded
left to right: take the longest token that matches (pyahocorasick, bytes mapped to Latin-1), step
down to shorter ones while it isn't compatible with the token before, and step back where none is.
Compatibility follows from the two tokens' own merges and is memoised; a place that was given up is
never tried again, so a piece takes time linear in its length, however long it is.

Work is per row: no exchange; the vocabulary is the only thing sent to the tasks. What a worker
remembers of words is bounded by ``Encoder.KEPT`` entries a generation.

Defined results: null and empty texts have no ids; equal texts give equal ids; other columns go
along (clashing names are replaced); decoding gives back the bytes of the text; bytes that are not
UTF-8 are read as U+FFFD, in the text column too; very long texts are encoded whole; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, read, small_batches


def load_ranks(data: bytes) -> list[bytes]:
    """The tokens by rank, of a file with lines of base64 token and rank."""
    pairs = (line.split() for line in data.splitlines() if line)
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """Tokens by rank with the tables that backtracking needs."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        self.merged: dict[tuple[int, int], int] = {}  # two tokens to the token that a merge makes of them
        self.parts = [(i, i) for i in range(len(tokens))]  # the two tokens of a token's last merge; itself for single bytes
        self.fits: dict[int, bool] = {}  # by left << 20 | right
        self.sizes = [len(t) for t in tokens]
        whole = []
        for i, token in enumerate(tokens):
            if len(token) > 1:
                pair = self._last_merge(i, token)
                if pair is None:
                    continue  # merges never make this token; only a piece that equals it is encoded so
                self.merged[pair], self.parts[i] = i, pair
            whole.append(i)
        self.shorter = [-1] * len(tokens)  # the longest token that is a proper prefix
        made = {tokens[i] for i in whole}
        for i in whole:
            token = tokens[i]
            self.shorter[i] = next((self.rank[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in made), -1)
        self.automaton = ahocorasick.Automaton()
        for i in whole:
            self.automaton.add_word(tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()

    def _last_merge(self, i: int, token: bytes) -> tuple[int, int] | None:
        for k in range(len(token) - 1, 0, -1):
            left, right = self.rank.get(token[:k], i), self.rank.get(token[k:], i)
            made = (len(token[:k]) == 1 or self.parts[left] != (left, left)) and (len(token[k:]) == 1 or self.parts[right] != (right, right)) if max(left, right) < i else False
            if made and self._compatible(left, right):
                return left, right
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges, given the two tokens' bytes, end with just these two."""
        pair = left << 20 | right
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) > 250_000:
                self.fits.clear()
            found = self.fits[pair] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges again and again. Where the tokens that touch
        # could be merged before the merge just undone took place, the boundary would not have lasted.
        limit = len(self.tokens) + 1
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                a, b = self.parts[left]
                if a != b or len(self.tokens[left]) > 1 and a != left:
                    limit, left = left, b
                    continue
                a, b = self.parts[right]
                if (a, b) == (right, right):
                    return True
                limit, right = right + 1, a
            else:
                a, b = self.parts[right]
                if (a, b) != (right, right):
                    limit, right = right + 1, a
                    continue
                a, b = self.parts[left]
                if (a, b) == (left, left):
                    return True
                limit, left = left, b

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece of text."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, fits, shorter = len(piece), self.sizes, self.fits.get, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[i]] = i  # ends grow, so a longer match comes later
        given_up = bytearray(n + 1)
        out, pos, token, last = [], 0, longest[0], -1
        while pos < n:
            end = pos + sizes[token]
            if not given_up[end]:
                fit = last < 0 or fits(last << 20 | token)
                if fit is None:
                    fit = self.compatible(last, token)
                if fit:
                    out.append(token)
                    pos, last = end, token
                    token = longest[pos] if pos < n else -1
                    continue
            token = shorter[token]
            while token < 0:  # no token serves here: step back to a shorter one before
                given_up[pos] = 1
                last = out.pop()
                pos -= sizes[last]
                token, last = shorter[last], out[-1] if out else -1
        return out


class Encoder:
    """Encodes texts: splits by the pattern, encodes pieces, remembers those of short words."""

    KEPT = 150_000

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern = data, pattern

    def __getstate__(self) -> tuple[bytes, str]:
        return self.data, self.pattern

    def __setstate__(self, state: tuple[bytes, str]) -> None:
        self.data, self.pattern = state

    @cached_property
    def vocabulary(self) -> Vocabulary:
        return Vocabulary(load_ranks(self.data))

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def odd(self):
        """Finds a space beside other white space: there a word's pieces depend on what stands before it."""
        return regex.compile(r" \s|\s ").search

    @cached_property
    def pieces(self) -> _Memo:
        return _Memo(lambda piece: array("i", self.vocabulary.encode(piece.encode())).tobytes(), self.KEPT)

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # one piece, as the pattern's letters are those of isalpha
            return self.pieces[" " + word]
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return self.pieces[" " + word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(" " + word)))

    @cached_property
    def spaced(self) -> _Memo:
        """Of a word, the ids of a space and the word."""
        return _Memo(self._word, self.KEPT)

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if not text or self.odd(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.split(first))) + b"".join(map(self.spaced.__getitem__, rest))


class _Memo(dict):
    """Remembers results for short keys in two generations, so that frequent ones outlast the bound."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 48:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def joined(tokens: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode(df: DataFrame, data: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) to ``df``. ``data``: a rank file's bytes; ``pattern``: what splits texts into pieces.

    With ``decoded``, a column of that name holds what the ids stand for, decoded in the same pass.
    """
    df = bounded_arrow(df.drop(ids, *([decoded] if decoded else []))).withColumn(text, F.make_valid_utf8(F.col(text).cast("string")))
    sent = df.sparkSession.sparkContext.broadcast(Encoder(data, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value
        for whole in batches:
            for batch in small_batches(whole, text):
                coded = [encoder.encode(x or "") for x in batch.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
                out = batch.append_column(ids, pa.ListArray.from_arrays(pa.array(ends), values))
                if decoded:
                    tokens = encoder.vocabulary.tokens
                    out = out.append_column(decoded, pa.array([joined(tokens, np.frombuffer(x, np.int32)) for x in coded], pa.binary()))
                yield out

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{ids}` array<int>" + (f", `{decoded}` binary" if decoded else "")
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, data: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for (null for null ids)."""
    sent = df.sparkSession.sparkContext.broadcast(load_ranks(data))

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else joined(sent.value, x) for x in rows], dtype=object)

    return df.withColumn(out, run(ids))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        data = file.read()
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), data, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
