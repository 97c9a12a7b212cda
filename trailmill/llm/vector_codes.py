"""Vector codes by product quantization, with delta-maintained Lloyd rounds.

Vectors become whole numbers and are cut into equal parts, each with a codebook
of its own.  The assignments of the round before lie beside the vectors in the
shared folder.  A round assigns every part anew, in numpy over Arrow batches,
then only rows with a changed part are read again: a task adds up plus and
minus contributions per (part, entry), so that a task sends one number per
changed entry and component at most, whatever its rows.  Running sums and
counts, whole numbers of any size, are kept for the entries only.  A hot label,
cluster or vector is thus never gathered anywhere.

Distances are |e|^2 - 2xe + |x|^2 as matrix products, in doubles while all
sums stay below 2^53 (whole numbers, so exact), else in Python's whole numbers.

Defined results: rows whose vector is null, empty, or holds null or non-finite
components are dropped, and so are those that cannot be cut as the others: of
another length than the smallest kept id's vector, or one that the parts do not
divide.  Ids need not be unique; equal ids go by their vectors, null ids come
last.  Ties of distance go to the lower entry.  Fewer vectors than entries give
fewer entries.  An error beyond a long is null.  Repeated rows count each.  An
empty table gives an empty result.  Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm._scratch import dropped, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096

LONGEST = 2**63 - 1


@dataclass
class Codebooks:
    """Entries by part, and the running sums and counts of the parts assigned to them; whole numbers throughout."""

    entries: list[list[list[int]]]
    sums: list[list[list[int]]] = field(init=False)
    counts: list[list[int]] = field(init=False)

    def __post_init__(self):
        self.sums = [[[0] * len(e) for e in part] for part in self.entries]
        self.counts = [[0] * len(part) for part in self.entries]

    def moved(self) -> None:
        """Every used entry becomes the floored mean of its parts."""
        for entries, sums, counts in zip(self.entries, self.sums, self.counts, strict=True):
            for k, n in enumerate(counts):
                if n:
                    entries[k] = [s // n for s in sums[k]]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def usable(vector: Column, parts: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & ~F.coalesce(bad, F.lit(False))


def whole_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) with floor(scale * x), as doubles: whole numbers of any size that a float reaches."""
    doubles = F.col("embedding").cast("array<double>")
    kept = vectors.filter(usable(doubles, parts))
    # Not F.floor: a long is too short for the largest floats.
    down = lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return kept.select("vec_id", "label", F.transform(doubles, down).alias("vector"))


def exact(values: np.ndarray, entries: np.ndarray) -> bool:
    """Whether all sums of a distance are whole numbers below 2^53."""
    widest = max(float(np.abs(values).max(initial=0)), float(max((abs(int(x)) for x in entries.flat), default=0)))
    return 4 * widest * widest * entries.shape[-1] < 2.0**53


def as_integers(values: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(values)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows, parts) of values (rows, parts, width) by entries (parts, entries, width) of Python ints."""
    if exact(values, entries):
        entries = entries.astype(np.float64)
    else:
        values = as_integers(values)
    codes = np.zeros(values.shape[:2], np.int32)
    errors = np.zeros(values.shape[:2], values.dtype)
    for p, book in enumerate(entries):
        x = values[:, p]
        d = (book * book).sum(1) - 2 * (x @ book.T)
        codes[:, p] = d.argmin(1)
        errors[:, p] = (x * x).sum(1) + d[np.arange(len(x)), codes[:, p]]
    return codes, errors


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def assigned(table: DataFrame, books: Codebooks) -> DataFrame:
    """The codes before as ``was``, those by ``books`` as ``now``, and the row's squared distance as ``error``."""
    shape = np.array(books.entries, dtype=object)  # PARTS * ENTRIES * width numbers
    parts = len(books.entries)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            codes, errors = nearest(_cut(at["vector"], parts), shape)
            error = [x if x <= LONGEST else None for x in (int(e) for e in errors.sum(1))] if errors.dtype == object else errors.astype(np.int64).sum(1)
            columns = {"vec_id": at["vec_id"], "label": at["label"], "vector": at["vector"], "was": at["now"], "now": _lists(codes), "error": pa.array(error, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector array<double>, was array<int>, now array<int>, error long"
    return table.select("vec_id", "label", "vector", "now").mapInArrow(assign, schema)


def changes(table: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, component, change) of the parts whose assignment changed; component -1 is the count.

    A task adds up its rows, so it sends as many rows as the codebooks have numbers at most.
    """
    parts, entries, width = len(books.entries), len(books.entries[0]), len(books.entries[0][0])

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            values, now = _cut(at["vector"], parts), _cut(at["now"], parts)[:, :, 0]
            first = at["was"].null_count == len(at["was"])
            was = np.full_like(now, -1) if first else _cut(at["was"], parts)[:, :, 0]
            small = float(np.abs(values).max(initial=0)) < 2.0**38  # a batch of 2^25 rows adds up in a long
            values = values.astype(np.int64) if small else as_integers(values)
            for p in range(parts):
                for codes, sign in ((now[:, p], 1), (was[:, p], -1)):
                    rows = np.flatnonzero((now[:, p] != was[:, p]) & (codes >= 0))
                    part = np.zeros((entries, width + 1), values.dtype)
                    np.add.at(part[:, 1:], codes[rows], values[rows, p])
                    part[:, 0] = np.bincount(codes[rows], minlength=entries)
                    sums[p] += sign * part.astype(object)
        p, e, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array((k - 1).astype(np.int32)), pa.array([Decimal(int(x)) for x in sums[p, e, k]], pa.decimal128(38, 0))],
            names=["part", "entry", "component", "change"],
        )

    rows = table.filter(~F.col("now").eqNullSafe(F.col("was"))).select("vector", "was", "now")
    return rows.mapInArrow(differences, "part int, entry int, component int, change decimal(38,0)").groupBy("part", "entry", "component").agg(F.sum("change").alias("change"))


def first_books(whole: DataFrame, parts: int, entries: int) -> tuple[Codebooks, int] | None:
    """Codebooks of the smallest ids' vectors and the common length; None without vectors.  Reads ``entries`` rows at most."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    least = whole.orderBy(*order).limit(1).select(F.size("vector").alias("n")).first()
    if least is None:
        return None
    length = least["n"]
    rows = whole.filter(F.size("vector") == length).orderBy(*order).limit(entries).select("vector").collect()
    width = length // parts
    return Codebooks([[[int(x) for x in r["vector"][p * width : (p + 1) * width]] for r in rows] for p in range(parts)]), length


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, vector, now, error) of all usable vectors, stored, and the final codebooks."""
    whole = written(whole_vectors(vectors, parts, scale), "codes-vectors")
    started = first_books(whole, parts, entries)
    none = F.lit(None).cast("array<int>")
    if started is None:
        return whole.withColumn("now", none).withColumn("error", F.lit(None).cast("long")), Codebooks([])
    books, length = started
    table, before = whole.filter(F.size("vector") == length).withColumn("now", none), whole
    for _ in range(rounds):
        table = written(assigned(table, books), "codes-round")
        dropped(before)
        before = table
        changed = changes(table, books).collect()  # one row per number of the codebooks at most
        if not changed:  # no later round would change anything either
            break
        for r in changed:
            p, e, k, x = r["part"], r["entry"], r["component"], int(r["change"])
            if k < 0:
                books.counts[p][e] += x
            else:
                books.sums[p][e][k] += x
        books.moved()
    final = written(assigned(table, books).drop("was"), "codes-final")
    dropped(before)
    return final, books


def restored(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Adds ``approximation``, the entries of a row's codes put together, in the unit of the given vectors."""
    tables = [F.array(*[F.array(*[F.lit(x / scale) for x in e]) for e in part]) for part in books.entries]
    return codes.withColumn("approximation", F.concat(*[F.element_at(t, F.element_at("now", p + 1) + 1) for p, t in enumerate(tables)]))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``.  Errors are added up per label first; a hot label's rows then meet one row, in as many tasks as Spark splits them."""
    per_label = coded.groupBy(F.col("label").alias("at_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("at_label"))).drop("at_label")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digits = F.array_join(F.transform("now", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return with_label_errors(coded).select("vec_id", digits.alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """Every round as two common tables: nearest entries, then floored means."""
    one_round = """,
near{i} AS MATERIALIZED (
  SELECT rid, p, any_value(parts.v) AS v, arg_min(e, d * 16 + e) AS e, min(d) AS d
  FROM (SELECT rid, parts.p, parts.v, e, list_sum(list_transform(range(1, len(parts.v) + 1), lambda k: (parts.v[k] - book{i}.v[k]) * (parts.v[k] - book{i}.v[k])))::BIGINT AS d
        FROM parts JOIN book{i} ON parts.p = book{i}.p) AS parts
  GROUP BY rid, p
)"""
    one_mean = """,
mean{i} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS v
  FROM (SELECT p, e, k, sum(v[k]) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS k FROM near{i}) GROUP BY p, e, k) GROUP BY p, e
), book{j} AS MATERIALIZED (
  SELECT p, e, coalesce(mean{i}.v, book{i}.v) AS v FROM book{i} LEFT JOIN mean{i} USING (p, e)
)"""
    steps = "".join(one_round.format(i=i) + (one_mean.format(i=i, j=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""
WITH usable AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS (
  SELECT * FROM usable WHERE len(v) = (SELECT len(v) FROM usable ORDER BY vec_id NULLS LAST, v LIMIT 1)
), parts AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM (SELECT rid, v, unnest(range(8)) AS p FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, place - 1 AS e, v FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS place FROM kept) USING (rid) WHERE place <= 16
){steps}, coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


OP12_SQL = _sql()
