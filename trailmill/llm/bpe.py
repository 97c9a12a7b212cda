"""Byte-pair encoding and decoding of whole texts by contiguous rank arrays.

A text is cut into pre-tokens by the vocabulary's pattern.  A short pre-token
keeps its parts and the ranks of adjacent parts in two flat lists: the lowest
rank is looked for, the boundary there is deleted, and the ranks on both sides
are looked up again, until no pair has a rank.  A list scan costs little while
words are short; words above LONG bytes, for which the scans would add up to
the square of their length, keep the ranks in a heap over linked parts instead
and merge in the same order.  Each distinct pre-token is merged once per worker,
as long as it is remembered.

Ids are kept packed as little-endian unsigned 32-bit integers.  Decoding joins
the bytes of the tokens and reads them as UTF-8, a wrong byte as U+FFFD.

Defined results: a null or empty text has no tokens and decodes to the empty
text; added tokens inside texts become their one id; repeated rows are encoded
alike; pre-tokens of very long texts are taken one by one, so that a text needs
memory for itself and its ids only; an empty table gives an empty result; other
columns are not touched; no ties arise, as no two pairs have the same rank.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a word from which on its pairs wait in a heap.
LONG = 128
#: Distinct pre-tokens that a worker remembers before it starts afresh, and the bytes of the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 256
#: Characters of a text from which on its pre-tokens are not listed at once.
LONG_TEXT = 1 << 20
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible Latin-1 characters are themselves, the rest follow from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(seen))
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        letters, model = byte_letters(), given["model"]
        ids = model["vocab"]
        self.tokens = [b""] * (max([*ids.values(), *(t["id"] for t in given["added_tokens"])], default=-1) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        for content, i in self.added.items():
            self.tokens[i] = content.encode()
        self.first = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        # (left, right) -> rank, and by rank the id of the whole
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.whole = [ids[a + b] for a, b in pairs]
        self.pieces = regex.compile(pattern)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.first[b] for b in word]
        return self._scanned(parts) if len(parts) <= LONG else self._heaped(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        rank, whole = self.rank.get, self.whole
        ranks = [rank(pair, NEVER) for pair in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at] = whole[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NEVER)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        rank, whole, n = self.rank.get, self.whole, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, pair in enumerate(pairwise(parts)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k]
            if parts[k] < 0 or right >= n or rank((parts[k], parts[right])) != r:  # merged meanwhile
                continue
            parts[k], parts[right] = whole[r], -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank((parts[before[k]], parts[k]))) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [x for x in parts if x >= 0]

    def _packed(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            word = piece.encode()
            found = np.array(self.merged(word), "<u4").tobytes()
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _stretch(self, text: str) -> bytes:
        """Packed ids of a text without added tokens."""
        if len(text) < LONG_TEXT:
            return b"".join(map(self._packed, self.pieces.findall(text)))
        return b"".join(self._packed(m.group()) for m in self.pieces.finditer(text))

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return self._stretch(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._stretch(text[at : m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._stretch(text[at:] if at else text)])

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of this Python worker, with what it remembers."""
    return Vocabulary(path, pattern)


def _mapped(df: DataFrame, source: str, added: str, kind: pa.DataType, path: str, pattern: str, work) -> DataFrame:
    """Adds a column that ``work`` (of a Vocabulary) makes of each value of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            made = pa.array([None if not v.is_valid else work(known, v.as_py()) for v in column], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, added])

    name = {pa.binary(): "binary", pa.string(): "string"}[kind]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{added}` {name}")


def encoded(texts: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the packed ids of a text column; null stays null.  ``path`` is read by the executors."""
    return _mapped(texts, text, ids, pa.binary(), path, pattern, lambda v, x: v.encode(x))


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of packed ids; null stays null."""
    return _mapped(rows, ids, text, pa.string(), path, pattern, lambda v, x: v.decode(x))


def op11_bpe(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(vocabulary), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encoded(docs, path, pattern).select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))
    return decoded(ids, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
