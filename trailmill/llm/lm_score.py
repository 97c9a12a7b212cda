"""Language-model scores: a hashed maximum-entropy model.

A token's probability is P(group | history) P(class | group, history)
P(token | class): softmax over 16 groups, over the 16 classes of a group, and
the smoothed share of the token among its class.  Classes hold about equal
mass, in order of frequency.  A history's features are a bias and hashes of the last word,
the pair of the last two, and the word two back (a skip); each hashes to one of
FEATURES rows of weights.

Training is gradient descent in ROUNDS over disjoint parts of all training
documents: each task starts from the broadcast weights, steps through its
documents in batches (AdaGrad), and the changes are summed over tasks, weighted
by tokens.  The weights' size is fixed by the parameters.  Token counts are a
Spark aggregation over all training documents; tokens frequent enough to be
among HEAD are looked up from a broadcast of that size, all others are joined.

Defined results: a null text is empty and still has its end token; a null
doc_id counts as the empty string in the split; repeated rows score alike; an
empty table gives an empty result; with no training document every token is unknown;
a very long text is scored whole by the task that reads it; tokens of equal counts
are ordered by hash; other columns are not touched.  The score, not the base,
depends on how the table is partitioned, since gradients are added up per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm._frequent import frequent
from trailmill.llm._scratch import written
from trailmill.llm._tokens import SPACED, U64, chunks, hex_free, mix, words_of

GROUPS = 16
FEATURES = 1 << 13
ROUNDS = 2
HEAD = 1 << 18
BATCH = 1 << 16
RATE = 0.4
BLOCK = 1 << 12
WEIGHT = -1
END = U64(0x0E5D0E5D0E5D0E5D)
START = U64(0x57A2757A2757A275)
RARE = GROUPS * GROUPS - 1
#: One odd multiplier per kind of feature: last, last two, two back.
KINDS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))
WIDTH = GROUPS + GROUPS * GROUPS


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in a row, each text with its end, and the text of each token."""
    w = words_of(texts, SPACED, lower=True)
    counts = w.counts
    tokens = np.full(len(w.hash) + len(texts), END)
    tokens[np.arange(len(w.hash)) + w.doc] = w.hash
    return tokens, np.repeat(np.arange(len(texts)), counts + 1)


def features(tokens: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Rows of weights of each token's history, one array for each kind; the bias is row FEATURES."""
    n = len(tokens)
    back = []
    for k in (1, 2):
        b = np.full(n, START)
        if n > k:
            b[k:] = np.where(text[k:] == text[:-k], tokens[:-k], START)
        back.append(b)
    kinds = (back[0], mix(back[0] * U64(3) + back[1]), back[1])
    shift = U64(64 - FEATURES.bit_length() + 1)
    return [((x * c) >> shift).astype(np.int64) for x, c in zip(kinds, KINDS, strict=True)]


@dataclass
class Vocabulary:
    """The head tokens by hash, their counts and classes; what the tail adds up to."""

    hash: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    mass: np.ndarray  # of each class, smoothed
    tokens: int
    types: int

    def __post_init__(self) -> None:
        self.first = np.searchsorted(self.hash, np.arange(1 << 18, dtype=U64) << U64(46)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(self.hash))).max(initial=0))

    def look_up(self, tokens: np.ndarray) -> np.ndarray:
        """Places in the head, -1 for the tail: by the hash's first bits, then along the few that share them."""
        found = np.full(len(tokens), -1)
        if not len(self.hash):
            return found
        at = self.first[(tokens >> U64(46)).astype(np.int64)].astype(np.int64)
        left = np.arange(len(tokens))
        for _ in range(self.most):
            here = np.minimum(at, len(self.hash) - 1)
            same = self.hash[here] == tokens[left]
            found[left[same]] = here[same]
            more = ~same & (self.hash[here] < tokens[left])
            left, at = left[more], at[more] + 1
        return found

    def classes(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.cls[at], RARE) if len(self.cls) else np.full(len(at), RARE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[np.ndarray] = []
        for _, texts in chunks(batch):
            held.append(sequences(texts)[0])
            if sum(map(len, held)) > 1 << 20:
                yield _unique(held)
                held = []
        if held:
            yield _unique(held)


def _unique(held: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(hex_free(h)), pa.array(n.astype(np.int64))], names=["token", "n"])


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all training texts, stored."""
    counted = train.select("text").mapInArrow(_counted, "token long, n long")
    return written(counted.groupBy("token").agg(F.sum("n").alias("c")), "lm-counts")


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The head, and the least count in it."""
    h, c, least, types, tokens = frequent(counts.select(F.col("token").alias("key"), "c"), HEAD)
    order = np.lexsort((h, -c))
    share = (np.cumsum(c[order]) - c[order] / 2) / max(1, tokens)
    cls = np.empty(len(c), np.int64)
    cls[order] = np.minimum((share * (RARE + 1)).astype(np.int64), RARE - 1)
    mass = np.bincount(cls, weights=c + 0.5, minlength=RARE + 1).astype(float)
    mass[RARE] = tokens - int(c.sum()) + 0.5 * (types - len(c) + 1)
    return Vocabulary(h, c, cls, mass, int(tokens), int(types)), least


def first_weights(vocabulary: Vocabulary) -> np.ndarray:
    """All zero but the bias, which starts at the classes' shares."""
    w = np.zeros((FEATURES + 1, WIDTH), np.float32)
    share = np.maximum(vocabulary.mass, 1e-3).reshape(GROUPS, GROUPS)
    w[FEATURES, :GROUPS] = np.log(share.sum(axis=1))
    w[FEATURES, GROUPS:] = np.log(share).ravel()
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    """Of the rows, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def forward(w1: np.ndarray, w2: np.ndarray, rows: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(. | history) over groups, and over the classes of the token's group.  w2 has a row for each (feature, group)."""
    a, b = w1[rows[0]], w2[rows[0] * GROUPS + group]
    for k in rows[1:]:
        a += w1[k]
        b += w2[k * GROUPS + group]
    a += w1[FEATURES]
    b += w2[FEATURES * GROUPS + group]
    return softmax(a), softmax(b)


class Trainer:
    """AdaGrad steps from given weights; the gradient of a row is taken per occurrence, shrunk for few."""

    def __init__(self, weights: np.ndarray):
        self.w1 = weights[:, :GROUPS].copy()
        self.w2 = weights[:, GROUPS:].reshape(-1, GROUPS).copy()
        self.g1, self.g2 = np.full_like(self.w1, 1e-3), np.full_like(self.w2, 1e-3)
        self.tokens = 0

    def step(self, rows: list[np.ndarray], cls: np.ndarray) -> None:
        n = len(cls)
        group, inner = cls // GROUPS, cls % GROUPS
        p1, p2 = forward(self.w1, self.w2, rows, group)
        p1[np.arange(n), group] -= 1
        p2[np.arange(n), inner] -= 1
        kinds = np.concatenate([*rows, np.full(n, FEATURES)])
        for w, g, at, grad in ((self.w1, self.g1, kinds, p1), (self.w2, self.g2, kinds * GROUPS + np.tile(group, len(rows) + 1), p2)):
            seen = np.bincount(at, minlength=len(w))
            on = np.flatnonzero(seen)
            d = np.empty((len(on), GROUPS), np.float32)
            for c in range(GROUPS):
                d[:, c] = np.bincount(at, weights=np.tile(grad[:, c], len(rows) + 1), minlength=len(w))[on]
            n_on = seen[on].astype(np.float32)[:, None] + 16
            d /= np.sqrt(n_on)
            g_on = g[on] + d * d
            g[on] = g_on
            w[on] -= RATE * d / np.sqrt(g_on) * (1 - 16 / n_on)
        self.tokens += n

    def weights(self) -> np.ndarray:
        return np.concatenate([self.w1, self.w2.reshape(len(self.w1), -1)], axis=1)


def changes(train: DataFrame, weights, vocabulary) -> DataFrame:
    """(block, salt, scale, change): each task's change of the weights, in blocks, and its tokens in millions, also as block WEIGHT."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before, known = weights.value, vocabulary.value
        trainer = None
        for batch in batches:
            for _, texts in chunks(batch):
                trainer = trainer or Trainer(before)
                tokens, text = sequences(texts)
                rows, cls = features(tokens, text), known.classes(known.look_up(tokens))
                for at in range(0, len(cls), BATCH):
                    trainer.step([r[at : at + BATCH] for r in rows], cls[at : at + BATCH])
        if trainer:
            scale = trainer.tokens / 1e6
            flat = np.zeros(-(-before.size // BLOCK) * BLOCK, np.float32)
            flat[: before.size] = (trainer.weights() - before).ravel()
            flat = flat.reshape(-1, BLOCK)
            on = np.flatnonzero(flat.any(axis=1))
            salt = TaskContext.get().partitionId() % GROUPS
            sent = [b.astype(np.float16).tobytes() for b in flat[on]] + [np.float64(scale).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*on.tolist(), WEIGHT]), *(pa.array(np.full(len(sent), x)) for x in (salt, scale)), pa.array(sent, pa.binary())],
                names=["block", "salt", "scale", "change"],
            )

    return train.select("text").mapInArrow(trained, "block long, salt long, scale double, change binary")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the changes of each block: halves as tasks send them (times their scale), doubles as sums."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, scale, change in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = np.frombuffer(change, np.float16).astype(np.float64) * scale if len(change) == 2 * BLOCK else np.frombuffer(change, np.float64)
            total[block] = total[block] + x if block in total else x
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary())
    rows = [(b, 0, 1.0, x.tobytes()) for b, x in sorted(total.items())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "salt", "scale", "change"])


def trained(train: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after ROUNDS over the training documents, each used in one round."""
    spark = train.sparkSession
    w = first_weights(vocabulary)
    known = spark.sparkContext.broadcast(vocabulary)
    # What a task sends is as large as the weights, so a task takes several of the scan's parts.
    parts = train.rdd.getNumPartitions()
    train = train.coalesce(max(1, min(parts, max(spark.sparkContext.defaultParallelism, parts // 8))))
    schema = "block long, salt long, scale double, change binary"
    for k in range(ROUNDS):
        part = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k)
        found = changes(part, spark.sparkContext.broadcast(w), known)
        found = found.repartition(F.col("block"), F.col("salt")).mapInArrow(_added, schema)
        found = found.repartition(F.col("block")).mapInArrow(_added, schema)
        share, flat = 0.0, np.zeros(-(-w.size // BLOCK) * BLOCK)
        for row in found.select("block", "change").collect():  # as many bytes as the weights have
            if row["block"] == WEIGHT:
                share = float(np.frombuffer(row["change"], np.float64)[0])
            else:
                flat[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["change"], np.float64)
        w = (w.astype(np.float64) + flat[: w.size].reshape(w.shape) / max(share, 1e-9)).astype(np.float32)
    return w


def _scorer(weights, vocabulary, kind: str):
    """Per document: counts and sums over its head tokens and classes; its tail tokens, which are joined."""
    names = ["row", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "score_head", "tail"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = weights.value, vocabulary.value
        w1, w2 = w[:, :GROUPS].copy(), w[:, GROUPS:].reshape(-1, GROUPS).copy()
        everything = np.log10(known.tokens + 0.5 * (known.types + 1))
        own = np.log10(known.count + 0.5)
        inside = own - np.log10(known.mass[known.cls])
        for batch in batches:
            for first, texts in chunks(batch):
                tokens, text = sequences(texts)
                at = known.look_up(tokens)
                cls = known.classes(at)
                rows = features(tokens, text)
                p = np.empty(len(tokens))
                for k in range(0, len(tokens), BATCH):
                    part = slice(k, k + BATCH)
                    group, inner = cls[part] // GROUPS, cls[part] % GROUPS
                    p1, p2 = forward(w1, w2, [r[part] for r in rows], group)
                    i = np.arange(len(group))
                    p[part] = np.log10(np.maximum(p1[i, group], 1e-30)) + np.log10(np.maximum(p2[i, inner], 1e-30))
                head = at >= 0
                n = len(texts)
                tail = tokens[~head]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(text[~head], minlength=n))]).astype(np.int32)
                part = batch.slice(first, n)
                sums = lambda x: pa.array(np.bincount(text[head], weights=x, minlength=n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(part.schema.get_field_index(c)) for c in names[:3]),
                        pa.array(np.bincount(text, minlength=n)),
                        pa.array(np.bincount(text[head], minlength=n)),
                        sums(own[at[head]] - everything),
                        pa.array(np.bincount(text, weights=p, minlength=n) + np.bincount(text[head], weights=inside[at[head]], minlength=n)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(hex_free(tail))),
                    ],
                    names=names,
                )

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, base_head double, score_head double, tail array<bigint>"
    return scored, schema


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = rows.filter(~F.col("held_out"))
    counts = token_counts(train)
    known, least = vocabulary(counts)
    weights = trained(train, known)
    scored, schema = _scorer(spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(known), docs.schema["doc_id"].dataType.simpleString())
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    found = written(numbered.mapInArrow(scored, schema), "lm-scored")
    tail = found.select(F.col("row").alias("tail_row"), F.explode("tail").alias("token")).groupBy("token", "tail_row").agg(F.count("*").alias("k"))
    rare = counts.filter(F.col("c") < least).select(F.col("token").alias("rare"), "c")
    seen = F.coalesce(F.col("c"), F.lit(0))
    # The tail's tokens lie by token for the join; no token of it is frequent in training, one that is elsewhere is split by the skew join.
    joined = tail.join(rare, F.col("token") == F.col("rare"), "left").select("tail_row", "k", F.log10(seen + 0.5).alias("own"), (seen > 0).alias("is_known"))
    per_row = joined.groupBy("tail_row").agg(
        F.sum("k").alias("tail_n"), F.sum(F.when(F.col("is_known"), F.col("k")).otherwise(0)).alias("tail_known"), F.sum(F.col("k") * F.col("own")).alias("tail_own")
    )
    everything, in_rare = np.log10(known.tokens + 0.5 * (known.types + 1)), np.log10(known.mass[RARE])
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.join(per_row, F.col("row") == F.col("tail_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + none("tail_known")).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base_head") + none("tail_own") - none("tail_n") * F.lit(float(everything))).alias("base_score"),
        (F.col("score_head") + none("tail_own") - none("tail_n") * F.lit(float(in_rare))).alias("score"),
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
