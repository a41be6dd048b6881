"""Best-fit packing of tokenised documents under several capacities.

Documents are tokenised whole, ended by an end id and cut into pieces of at most the token capacity
(a first piece takes the remainder).  A piece needs tokens, one unit of the document count and an
attention cost, the square of its length.  These follow from its length, so the pieces fall
into at most as many classes as there are lengths, and the packing is solved once for all
pieces on the counts of those classes: classes come in descending order of size, and bins with equal
residual capacities are kept as one group.  A class goes to the group that fits best, by the norm of
what would be left (``score="norm"``) or by the weighted dot product of need and residual
(``score="dot"``), and fills its bins as far as every capacity allows; new bins are opened when no group
fits.  The plan, a list of (class, ranks, bins), is bounded by the number of classes, not
by the data.  A piece finds its place from its rank within its class, which
is the number of such pieces in earlier written chunks plus its number within its own chunk.

With the default capacities, which the query and the pipeline use (1,024 documents, a cost of 1,024 squared), only the
tokens bind: pieces that hold 1,024 tokens together are at most so many and their squares sum to at most that cost.
The other capacities bind when smaller ones are given; test_best_fit_respects_every_capacity covers them.

Defined results: null text is empty and gives one piece, the end id alone; repeated rows and
identifiers, also null ones, are separate documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodefield.llm.common import map_frames, new_folder, table

TOKENS = 1024
END_ID = 2
#: Weights of tokens, document count and attention cost in the fit; tokens are what sequences run out of.
WEIGHTS = (1.0, 0.01, 0.01)
_SPECIAL = "<|endoftext|>"
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, chunk int, number bigint, ids array<int>"


@dataclass(frozen=True)
class Vocabulary:
    """Files of a byte-level BPE: for the tokenizers library, and the same ranks for tiktoken, which is faster."""

    json: str
    ranks: str
    pattern: str


def public_vocabulary() -> Vocabulary:
    import public_tokenizers as files

    return Vocabulary(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


@lru_cache(maxsize=2)
def _encoders(vocabulary: Vocabulary):
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(vocabulary.json)


def encode(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    """Ids as the tokenizers library gives them without added special tokens (a special token's own string in a text counts as that token)."""
    fast, exact = _encoders(vocabulary)
    text = text or ""
    ids = exact.encode(text, add_special_tokens=False).ids if _SPECIAL in text else fast.encode_ordinary(text)
    return np.array(ids, dtype="<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: only the first may be shorter than ``size``."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))] if n else []


def pieces_of(docs: DataFrame, vocabulary: Vocabulary, size: int = TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written pieces: ``doc_id, piece, start, length, ids_crc32, ids`` and the place ``chunk, number`` in which each was written.

    ``number`` counts the pieces of one length within a chunk (a task of the write).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = context.partitionId() if context else 0
        seen = np.zeros(size + 1, np.int64)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
            ("chunk", pa.int32()), ("number", pa.int64()), ("ids", pa.list_(pa.int32()))])

        def made(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            bounds = np.concatenate(([0], np.cumsum(columns[3]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).view(np.int32)))
            arrays = [pa.array(c, t.type) for c, t in zip(columns, schema)]
            return pa.RecordBatch.from_arrays([*arrays, values], schema=schema)

        for batch in batches:
            rows, ids, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = np.append(encode(text.as_py(), vocabulary), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(whole), size)):
                    part = whole[start : start + length]
                    rows.append((doc_id, k, start, length, zlib.crc32(part.tobytes()), chunk, int(seen[length])))
                    ids.append(part)
                    seen[length] += 1
                    held += length
                    if held >= 1_000_000:
                        yield made(rows, ids)
                        rows, ids, held = [], [], 0
            if rows:
                yield made(rows, ids)

    spark = docs.sparkSession
    path = new_folder(spark, "pieces")
    docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, _PIECES).write.parquet(path)
    return spark.read.parquet(path)


@dataclass
class Plan:
    """Where the ranks of each class go; parallel arrays sorted by (class, first rank)."""

    key: np.ndarray  # class << 44 | first rank
    first_bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray  # tokens in those bins before
    bins: int


def best_fit(
    counts: dict[int, int],
    need,
    capacity: tuple[float, ...],
    weights: tuple[float, ...] = WEIGHTS,
    score: str = "norm",
) -> Plan:
    """Pack ``counts[c]`` items of every class ``c`` into bins of the given capacities.

    ``need(c)`` is the vector of a class; its first entry, tokens, gives the offsets.
    """
    full, w = np.array(capacity, float), np.array(weights, float)
    wants = {c: np.array(need(c), float) for c, n in counts.items() if n}
    order = sorted(wants, key=lambda c: (-float((w * (wants[c] / full) ** 2).sum()), -c))
    left = np.empty((64, len(full)))  # residual capacities of each group
    live = np.zeros(64, bool)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(64)]  # (first bin, bins) of each group
    where: dict[tuple, int] = {}
    free = list(range(63, -1, -1))
    events: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(residual: np.ndarray, start: int, n: int) -> None:
        nonlocal left, live
        group = where.get(tuple(residual))
        if group is None:
            if not free:
                size = len(live)
                left, live = np.vstack([left, np.empty_like(left)]), np.concatenate([live, np.zeros(size, bool)])
                ranges.extend([] for _ in range(size))
                free.extend(range(2 * size - 1, size - 1, -1))
            group = where[tuple(residual)] = free.pop()
            left[group], live[group], ranges[group] = residual, True, []
        ranges[group].append((start, n))

    for c in order:
        want, todo, rank = wants[c], counts[c], 0
        if (want > full).any():
            raise ValueError(f"an item of class {c} does not fit an empty bin")
        while todo:
            fits = live & (left >= want).all(axis=1)
            group = None
            if fits.any():
                at = np.flatnonzero(fits)
                if score == "dot":
                    value = -((w * (want / full)) * (left[at] / full)).sum(axis=1)
                else:
                    value = (w * ((left[at] - want) / full) ** 2).sum(axis=1)
                group = int(at[np.argmin(value)])
            residual = full if group is None else left[group].copy()
            with np.errstate(divide="ignore"):
                most = int(min(np.floor(residual / np.where(want > 0, want, np.nan))[want > 0]))
            if group is None:
                n = max(todo // most, 1)
                start, bins = bins, bins + n
            else:
                start, have = ranges[group].pop()
                n = min(have, max(todo // most, 1))
                if n < have:
                    ranges[group].append((start + n, have - n))
                if not ranges[group]:
                    live[group] = False
                    del where[tuple(residual)]
                    free.append(group)
            each = min(most, todo)
            events.append(((c << 44) | rank, start, each, int(full[0] - residual[0])))
            put(residual - each * want, start, n)
            rank, todo = rank + n * each, todo - n * each
    events.sort()
    columns = np.array(events, np.int64).reshape(-1, 4).T
    return Plan(columns[0], columns[1], columns[2], columns[3], bins)


def place(pieces: DataFrame, capacity_docs: int = TOKENS, capacity_cost: float = float(TOKENS) ** 2, size: int = TOKENS,
          weights: tuple[float, ...] = WEIGHTS, score: str = "norm") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for the written pieces."""
    per_chunk = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, lambda c: (c, 1, c * c), (size, capacity_docs, capacity_cost), weights, score)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "chunk", "number").join(earlier, ["chunk", "length"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), (b["number"] + b["earlier"]).to_numpy(np.int64)
            at = np.searchsorted(plan.key, (length << 44) | rank, side="right") - 1
            within = rank - (plan.key[at] & ((1 << 44) - 1))
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=plan.first_bin[at] + within // plan.per_bin[at], offset=plan.offset[at] + within % plan.per_bin[at] * length)

    return map_frames(
        ranked.drop("chunk"), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """Written pieces with their ids, and the place of every piece."""
    pieces = pieces_of(docs, vocabulary or public_vocabulary())
    return pieces, place(pieces, **settings)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all documents."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))[1]
