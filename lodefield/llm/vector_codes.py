"""Vector code compression: codebooks per part of a vector, nearest entries found by Orchard search.

Components become integers and a vector is cut into consecutive parts; a code has an entry of the part's codebook for
each part.  Codebooks start as the parts of the vectors with the smallest identifiers.  A round assigns every part to its
nearest entry and then replaces each entry by the floored mean of its parts; sums per entry are made in the tasks that assign and
added by Spark, so a round moves as many rows as codebooks have, not vectors.

Orchard search: every entry keeps the list of all entries sorted by their distance from it.  A search goes along the list of its
best entry, jumps to the list of any better one it meets, marks what it has compared and stops at the first entry that lies more
than twice the best distance away from the best entry, because by the triangle inequality no later one can be nearer.  All parts of
a batch search side by side.  Distances are whole numbers, so ties are exact: the lower index wins.

Defined results: rows whose vector is null or holds null, NaN or infinite components are left out.  Floored components beyond
``LARGEST`` (2^26) on either side are taken as that, which keeps every sum within 64 bits.  Vectors of another length than the
commonest (of equally common ones the longest), and all if the commonest cannot be cut into equal parts, stay with a null code and a null error, and take no part
in the codebooks.  A null identifier counts as larger than any other; equal identifiers start in the order of their
components.  With fewer vectors than entries, the codebooks have as many entries as there are vectors.  Equal rows get equal codes.
Nulls are one label.  A sum of errors that does not fit in 64 bits is null.  An empty table gives an empty result.  Further columns are carried along and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join
from lodefield.llm.common import new_folder, private, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 26
#: Entries of a list that a search compares at once, and vectors that search side by side.
_STRIDE = 128
_SIDE_BY_SIDE = 16_384


class Orchard:
    """The entries of one codebook (whole numbers, a row each) with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        n = len(entries)
        apart = np.stack([((self.entries - e) ** 2).sum(axis=1) for e in self.entries]) if n else np.empty((0, 0), np.int64)
        #: Neighbours of every entry, nearest first (itself among the first), and their squared distances.
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.far = np.take_along_axis(apart, self.near, axis=1)
        sums = self.entries.sum(axis=1)
        self._by_sum = np.argsort(sums, kind="stable")
        self._sums = sums[self._by_sum]

    def _start(self, x: np.ndarray) -> np.ndarray:
        """An entry with a sum of components close to that of each row."""
        at = np.searchsorted(self._sums, x.sum(axis=1)).clip(0, len(self._sums) - 1)
        return self._by_sum[at]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of equally near ones) and its squared distance, for every row."""
        # Doubles multiply faster and are as exact while every term stays a whole number below 2^53.
        top = max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0), 1)
        kind = np.float64 if 4 * int(top) ** 2 * max(x.shape[1], 1) < 1 << 53 else np.int64
        entries = self.entries.astype(kind)
        found, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), _SIDE_BY_SIDE):
            part = slice(lo, lo + _SIDE_BY_SIDE)
            found[part], least[part] = self._search(x[part].astype(kind), entries)
        return found, least

    def _search(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(x), len(entries)
        own, theirs = (x * x).sum(axis=1), (entries * entries).sum(axis=1)
        best = self._start(x)
        least = ((x - entries[best]) ** 2).sum(axis=1)
        seen = np.zeros((n, size), bool)
        seen[np.arange(n), best] = True
        going = np.arange(n)
        while len(going):
            going = going[np.argsort(best[going], kind="stable")]
            ends = np.flatnonzero(np.diff(best[going])) + 1
            jumped = []
            # Rows with the same best entry go along its list together; those that meet a better one leave for its list.
            for rows in np.split(going, ends):
                owner = best[rows[0]]
                far, near = self.far[owner], self.near[owner]
                for lo in range(0, size, _STRIDE):
                    rows = rows[far[lo] <= 4 * least[rows]]
                    if not len(rows):
                        break
                    met, reach = near[lo : lo + _STRIDE], far[lo : lo + _STRIDE]
                    new = ~seen[np.ix_(rows, met)] & (reach <= 4 * least[rows][:, None])
                    seen[np.ix_(rows, met)] |= new
                    d = own[rows][:, None] - 2 * (x[rows] @ entries[met].T) + theirs[met]
                    # The nearest of those met; of equally near ones, the lowest index.
                    nearest = np.where(new, d, np.inf if d.dtype == np.float64 else np.iinfo(np.int64).max).min(axis=1)
                    lowest = np.where(new & (d == nearest[:, None]), met, size).min(axis=1)
                    better = (lowest < size) & ((nearest < least[rows]) | ((nearest == least[rows]) & (lowest < owner)))
                    gone = rows[better]
                    best[gone], least[gone] = lowest[better], nearest[better]
                    jumped.append(gone)
                    rows = rows[~better]
            going = np.concatenate(jumped) if jumped else going[:0]
        return best, least.astype(np.int64)


@dataclass(frozen=True)
class Codebooks:
    """Entries by part: ``books[part][entry]`` is a row of whole numbers."""

    books: tuple[np.ndarray, ...]
    width: int

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(c)) for book in self.books for c in book.ravel()).encode()).hexdigest()

    def encode(self, q: Column) -> Column:
        """``code`` (two hex digits per part) and ``error`` of a column of whole-number vectors; nulls for other lengths."""
        width, books, step = self.width, self.books, self.width // max(len(self.books), 1)

        @F.pandas_udf("code string, error long")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            orchards = [Orchard(b) for b in books]
            for batch in batches:
                fits = np.array([v is not None and len(v) == width for v in batch], bool)
                code, error = np.full(len(batch), None, object), pd.array([pd.NA] * len(batch), "Int64")
                if fits.any() and len(orchards) and len(books[0]):
                    x = np.stack([np.asarray(v, np.int64) for v in batch[fits]]).reshape(int(fits.sum()), width)
                    found = [o.search(x[:, i * step : (i + 1) * step]) for i, o in enumerate(orchards)]
                    code[fits] = ["".join(f"{int(e):02x}" for e in row) for row in zip(*(f[0] for f in found))]
                    error[fits] = sum(f[1] for f in found)
                yield pd.DataFrame({"code": code, "error": error})

        return run(q)

    def decode(self, code: Column) -> Column:
        """The whole-number vector that a code stands for; null for a null code."""
        books = self.books

        @F.pandas_udf("array<long>")
        def run(codes: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else np.concatenate([b[int(c[2 * i : 2 * i + 2], 16)] for i, b in enumerate(books)]) for c in codes])

        return run(code)


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole_numbers(vector: Column, scale: int = SCALE, largest: int = LARGEST) -> Column:
    """Floored multiples of the components, within ``largest`` of zero."""
    return F.transform(vector.cast("array<double>"), lambda c: F.greatest(
        F.least(F.floor(c * float(scale)).cast("double"), F.lit(float(largest))), F.lit(float(-largest))).cast("int"))


def _commonest(sizes: DataFrame, parts: int) -> int:
    top = sizes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    return top[0]["width"] if top and top[0]["width"] % parts == 0 else -1


def _sums(vectors: DataFrame, books: list[np.ndarray], step: int) -> list[dict[int, np.ndarray]]:
    """For each part and used entry: the number of its parts, then the sums of their components."""
    # At least one column, so that vectors without components are counted too.
    names = [f"s{i}" for i in range(step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchards = [Orchard(b) for b in books]
        total = np.zeros((len(books), len(books[0]), step + 1), np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            for part, orchard in enumerate(orchards):
                mine = x[:, part * step : (part + 1) * step]
                found, _ = orchard.search(mine)
                np.add.at(total[part], found, np.column_stack((np.ones(len(mine), np.int64), mine)))
        part, entry = np.nonzero(total[:, :, 0])
        rows = total[part, entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), *(pa.array(c, pa.int64()) for c in rows.T)], ["part", "entry", "n", *names])

    schema = ", ".join(["part int", "entry int", "n bigint", *(f"{c} bigint" for c in names)])
    rows = vectors.mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n"), *(F.sum(c) for c in names)).collect()
    out: list[dict[int, np.ndarray]] = [{} for _ in books]
    for r in rows:
        out[r[0]][r[1]] = np.array(r[2:], np.int64)
    return out


def fit(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the rows of ``vectors`` (``id, q``) whose ``q`` has ``width`` components.

    The driver holds the codebooks only: ``parts * entries`` rows of ``width / parts`` numbers.
    """
    if width < 0:
        return Codebooks((), width)
    step = width // parts
    same = vectors.filter(F.size("q") == width)
    first = [r["q"] for r in same.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()]
    start = np.array(first, np.int64).reshape(len(first), width)
    books = [start[:, i * step : (i + 1) * step].copy() for i in range(parts)]
    for _ in range(rounds if len(first) else 0):
        for book, used in zip(books, _sums(same.select("q"), books, step)):
            for entry, s in used.items():
                book[entry] = s[1:] // s[0]
    return Codebooks(tuple(books), width)


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """Rows with a usable vector as a struct ``row`` of the columns of ``df``, with ``code`` and ``error``; and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is written with two hex digits")
    spark = df.sparkSession
    at = new_folder(spark, "vector-whole")
    vector = F.col(f"`{vector_col}`")
    whole = df.filter(usable(vector)).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != vector_col]).alias("row"), F.col(f"`{id_col}`").alias("id"), whole_numbers(vector).alias("q"))
    whole.write.parquet(at)
    whole = spark.read.parquet(at)
    books = fit(whole.select("id", "q"), _commonest(whole.select(F.size("q").alias("width")), parts), parts, entries, rounds)
    coded = whole.withColumn("found", books.encode(F.col("q"))) if books.books else whole.withColumn(
        "found", F.lit(None).cast("struct<code:string,error:bigint>"))
    return coded.select("row", F.col("found.code").alias("code"), F.col("found.error").alias("error")), books


def with_label_error(coded: DataFrame, label: Column) -> DataFrame:
    """Add ``label_error``, the errors summed over rows of an equal label (nulls together)."""
    value, missing, total = (private(coded, c) for c in ("label_value", "label_missing", "label_sum"))
    keyed = coded.withColumn(value, F.coalesce(label.cast("string"), F.lit(""))).withColumn(missing, label.isNull())
    at = new_folder(coded.sparkSession, "vector-labels")
    keyed.groupBy(value, missing).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias(total)).write.parquet(at)
    sums = coded.sparkSession.read.parquet(at)
    joined = lookup_join(keyed, sums, [value, missing], small_rows=sums.count(), max_broadcast=100_000)
    return joined.withColumn("label_error", F.expr(f"try_cast(`{total}` as bigint)")).drop(value, missing, total)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per usable vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    at = new_folder(spark, "vector-codes")
    rows.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), "code", "error").write.parquet(at)
    coded = with_label_error(spark.read.parquet(at), F.col("label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql() -> str:
    """Every distance of every round, spelled out."""
    dist = "list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, b.q) + list_inner_product(b.q, b.q)"
    assign = f"select v.vec_id, v.part, min(struct_pack(d := {dist}, e := b.entry)) as best from v join b{{k}} b using (part) group by all"
    text = """
with whole as materialized (
    select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)) as q from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (
    select vec_id, part, q[part * len(q) // 4 + 1 : (part + 1) * len(q) // 4] as q from whole, range(4) r(part)),
b0 as materialized (
    select part, row_number() over (partition by part order by vec_id) - 1 as entry, q from v
    qualify row_number() over (partition by part order by vec_id) <= 256),
"""
    for k in range(ROUNDS):
        text += f"""a{k} as materialized ({assign.format(k=k)}),
m{k} as (
    select part, entry, list(mean order by pos) as q from (
        select v.part, a.best.e as entry, pos, floor(sum(v.q[pos + 1]) / count(*)) as mean
        from v join a{k} a using (vec_id, part), range(16) p(pos) group by all)
    group by all),
b{k + 1} as materialized (select part, entry, coalesce(m{k}.q, b{k}.q) as q from b{k} left join m{k} using (part, entry)),
"""
    return text + f"""last as materialized ({assign.format(k=ROUNDS)}),
codes as (
    select vec_id, string_agg(printf('%02x', best.e::int), '' order by part) as code, sum(best.d)::bigint as error from last group by 1),
book as (
    select sha256(string_agg(q[pos + 1]::bigint::varchar, ',' order by part, entry, pos)) as codebooks_sha256
    from b{ROUNDS}, range(16) p(pos))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from codes join whole using (vec_id), book
"""


OP12_SQL = _sql()
