"""Token counts by the whole-token shortcut.

Texts are cut into pre-tokens by the vocabulary's pattern.  Which vocabulary
strings encode alone as exactly one token is proved once, on the driver, by
encoding each; a pre-token among them counts one without any merging.  Only the
others go through the library's merges, each distinct one once per worker.

Defined results: a null or empty text has no tokens; special strings inside
texts count as the one special token, as is the library's default; repeated
rows are counted alike; an empty table gives an empty result; a very long text is
counted by the task that reads it; no ties arise; other columns are not touched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Distinct merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 200_000


def _unicode_of_bytes() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes are themselves, the others follow from 256."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return table


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that the library encodes alone as one token: a list that the vocabulary bounds."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table, strings = _unicode_of_bytes(), []
    for token in vocabulary:
        try:
            strings.append(bytes(table[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):  # not a text of its own
            continue
    encoded = Tokenizer.from_file(path).encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1]


class Counter:
    """Counts tokens of texts; one per Python worker."""

    def __init__(self, path: str, whole: list[str], pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(pattern).findall
        tokenizer = self.tokenizer

        class Known(dict):
            def __missing__(known, piece: str) -> int:
                if len(known) > len(whole) + REMEMBERED:
                    known.clear()
                    known.update(dict.fromkeys(whole, 1))
                n = known[piece] = len(tokenizer.encode(piece, add_special_tokens=False).ids)
                return n

        self.known = Known(dict.fromkeys(whole, 1))

    def count(self, text: str) -> int:
        n, at = 0, 0
        if self.special:
            for m in self.special.finditer(text):
                n += 1 + sum(map(self.known.__getitem__, self.pieces(text[at : m.start()])))
                at = m.end()
        return n + sum(map(self.known.__getitem__, self.pieces(text[at:] if at else text)))


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            n = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.compute.binary_length(texts).cast(pa.int64())], names=["doc_id", "n_tokens", "n_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_tokens long, n_bytes long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op5_token_counts(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
