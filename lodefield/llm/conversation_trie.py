"""Prefix trie of conversations by burst tries.

Every conversation is a sequence of turn ids (digests of role and text); equal sequences are one with a count.  All start in one
suffix container under the root.  A container with more turns than ``CONTAINER`` bursts: the turns that all its sequences share
become a chain of trie heads, and each sequence goes to the container of its next turn id below the last head, until the containers are small.
Settled containers are dealt to shards, each sorted by container and sequence, and swept in one pass: a stack holds the open nodes
of the current sequence, and a node is closed, with the counts of its subtree, when a sequence leaves it.  Counts below the heads are
then sums over the tops of the containers, added by head.

Copies never make a container large, since they are one sequence, and a container with one sequence is settled at any length.  A task holds the open
nodes and, until a node closes, its children: at most one container and one sequence.  The identifiers that end at a node
are sorted by Spark over (sequence, identifier), joined in chunks, and the digest of the chunks is taken as a stream.

Defined results: rows without a ``conv_id`` belong to no conversation; a null turn comes first; turns of equal number are taken in the order
of role, then digest, and repeated rows are turns of their own; null role or text is empty; a conversation without turns ends at the root; an empty table gives no nodes.
Texts of any length enter as digests and byte counts.  The turn ids of one conversation (about 50 bytes a turn) must fit in a task.  Further columns are
ignored and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join
from lodefield.llm.common import new_folder, table

#: Turns beyond which a container of several sequences bursts.
CONTAINER = 1_024
#: Identifiers that one piece of a node's list holds.
CHUNK = 10_000
#: Heads that are broadcast; more are joined by shuffle.
_BROADCAST_HEADS = 20_000
_SHARE = 5
_HEAD_TURNS = 9

_NODE = "conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of a digest of role and text; the length of the role keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, seq``: the sequences of turns (``id``, ``bytes``) that share beginnings.

    Conversation ``c`` takes its first ``h = crc32(c) % 9`` turns from ``c - c % 5`` and the rest from itself.
    """
    c = F.col("conv_id")
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    # Partitioned by the conversation that lends its beginning, so that the join needs no shuffle of its own.
    lender = c - c % _SHARE
    rows = turns.filter(c.isNotNull()).select(
        c.cast("bigint").alias("conv_id"), lender.cast("bigint").alias("lender"), F.struct(
            F.col("turn").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), turn_id(role, text).alias("id"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes")).alias("at"))
    whole = rows.groupBy("lender", "conv_id").agg(F.transform(
        F.sort_array(F.collect_list("at")), lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("own"))
    whole = _written(whole, "trie-sequences")
    first = whole.filter("conv_id = lender").select("lender", F.slice("own", 1, _HEAD_TURNS - 1).alias("lent"))
    h = (F.crc32(c.cast("string")) % _HEAD_TURNS).cast("int")
    lent = F.slice(F.coalesce("lent", F.slice("own", 1, 0)), F.lit(1), h)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return whole.join(first, "lender", "left").select("conv_id", F.concat(lent, rest).alias("seq"))


def _ends(members: DataFrame) -> DataFrame:
    """``key, ends``: the digest of the members' decimal identifiers, ascending and joined by commas, of each sequence with several."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key and identifier; a run is cut into pieces of bounded length.
        key, ids = None, []
        for batch in batches:
            out = []
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) >= CHUNK):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(i)
            yield _batch(out, _CHUNKS)
        if ids:
            yield _batch([(key, ids[0], ",".join(map(str, ids)))], _CHUNKS)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and k != key:
                    out.append((key, state.hexdigest()))
                    state = None
                if state is None:
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(f",{piece}".encode())
            yield _batch(out, _DIGESTS)
        if state is not None:
            yield _batch([(key, state.hexdigest())], _DIGESTS)

    pieces = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = pieces.mapInArrow(chunks, "key string, first bigint, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key string, ends string")


_CHUNKS = pa.schema([("key", pa.string()), ("first", pa.int64()), ("piece", pa.string())])
_DIGESTS = pa.schema([("key", pa.string()), ("ends", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _distinct(sequences: DataFrame) -> DataFrame:
    """A row per distinct sequence: ``ids, bytes, conv`` (smallest member), ``n, ends``."""
    keyed = _written(sequences.select(
        "conv_id", F.sha2(F.array_join(F.transform("seq", lambda t: F.hex(t["id"])), ","), 256).alias("key"), "seq"), "trie-keyed")
    classes = _written(keyed.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")), "trie-classes")
    # The sequence itself travels once, from its smallest member.
    one = keyed.join(classes.withColumnRenamed("conv", "conv_id"), ["key", "conv_id"])
    several = classes.filter("n > 1").select("key")
    ends = _ends(lookup_join(keyed.select("key", "conv_id"), several, ["key"], "left_semi", small_rows=several.count(), max_broadcast=_BROADCAST_HEADS))
    return one.join(ends, "key", "left").select(
        F.col("seq.id").alias("ids"), F.col("seq.bytes").alias("bytes"), F.col("conv_id").alias("conv"), "n",
        F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends"))


def _common(a: Column, b: Column) -> Column:
    """Length of the beginning that two arrays share; equal arrays share all."""
    differs = F.transform(F.arrays_zip(a.alias("l"), b.alias("r")), lambda p: ~p["l"].eqNullSafe(p["r"]))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _burst(rows: DataFrame, container: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Settled containers and the heads above them, level by level."""
    settled, heads = [], []
    while True:
        counts = rows.groupBy("box").agg(
            F.count(F.lit(1)).alias("sequences"), F.sum(F.size("ids") - F.col("depth")).alias("turns"))
        large = _written(counts.filter((F.col("turns") > container) & (F.col("sequences") > 1)).select("box"), "trie-large")
        many = large.count()
        if not many:
            return [*settled, rows], heads
        inside = lookup_join(rows, large, ["box"], small_rows=many, max_broadcast=_BROADCAST_HEADS)
        found = inside.groupBy("box").agg(
            F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by("bytes", "ids").alias("bytes"), F.min("conv").alias("head_conv"),
            F.sum("n").alias("n_convs"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.first("parent_conv").alias("parent_conv"))
        # All sequences of a container share what its least and its greatest share.
        found = found.withColumn("until", _common(F.col("low"), F.col("high")))
        found = _written(found.withColumn("chain", F.slice("low", F.col("depth") + 1, F.col("until") - F.col("depth"))), "trie-heads")
        joined = lookup_join(rows, found.select("box", "until", "head_conv"), ["box"], "left", small_rows=many, max_broadcast=_BROADCAST_HEADS)
        settled.append(_written(joined.filter("until is null").drop("until", "head_conv"), "trie-settled"))
        going = joined.filter("until is not null")
        next_id = F.element_at("ids", F.col("until") + 1)
        moved = _written(going.filter(F.size("ids") > F.col("until")).select(
            F.sha2(F.concat("box", F.lit("/"), F.hex(next_id), F.lit("@"), F.col("until").cast("string")), 256).alias("box"),
            (F.col("until") + 1).alias("depth"), F.concat("above", F.array("box")).alias("above"), F.col("head_conv").alias("parent_conv"),
            "ids", "bytes", "conv", "n", "ends"), "trie-moved")
        # At most one distinct sequence of a container ends at its last head.
        ended = going.filter(F.size("ids") == F.col("until")).select("box", "ends")
        boxes = moved.select(F.element_at("above", -1).alias("box"), F.col("box").alias("child")).distinct()
        children = boxes.groupBy("box").agg(F.count(F.lit(1)).alias("n_children"))
        heads.append(found.join(ended, "box", "left").join(children, "box", "left"))
        rows = moved


class _Open:
    """A node whose subtree is being swept."""

    __slots__ = ("depth", "size", "conv", "n", "ends", "leaves", "saved", "children")

    def __init__(self, depth: int, size: int) -> None:
        self.depth, self.size = depth, size
        self.conv, self.n, self.ends, self.leaves, self.saved = None, 0, None, 0, 0
        self.children: list[tuple] = []


_SWEPT = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("above", pa.list_(pa.string()))])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted containers; the top of a container carries the heads above it."""
    box, parent, above, before, open_, out = None, None, None, [], [], []

    def close() -> None:
        node = open_.pop()
        saved = node.saved + (node.n - 1) * node.size
        leaves = node.leaves if node.children else 1
        for conv, depth, n, children, its_leaves, its_saved, ends in node.children:
            out.append((conv, depth, node.conv, n, children, its_leaves, its_saved, ends, None))
        row = (node.conv, node.depth, node.n, len(node.children), leaves, saved, node.ends or _NOTHING)
        if open_:
            up = open_[-1]
            up.children.append(row)
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            up.n, up.leaves, up.saved = up.n + node.n, up.leaves + leaves, up.saved + saved
        else:
            out.append((row[0], row[1], parent, *row[2:], above))

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            its_box, depth, its_above, its_parent, ids, sizes, conv, n, ends = row
            shared = depth
            if its_box != box:
                while open_:
                    close()
                box, parent, above = its_box, its_parent, its_above
                open_.append(_Open(depth, sizes[depth - 1] if depth else 0))
            else:
                most = min(len(ids), len(before))
                while shared < most and ids[shared] == before[shared]:
                    shared += 1
                while open_[-1].depth > shared:
                    close()
            for d in range(shared, len(ids)):
                open_.append(_Open(d + 1, sizes[d]))
            node = open_[-1]
            node.ends, node.n = ends, node.n + n
            node.conv = conv if node.conv is None else min(node.conv, conv)
            before = ids
            if len(out) >= 10_000:
                yield _batch(out, _SWEPT)
                out.clear()
    while open_:
        close()
    yield _batch(out, _SWEPT)


def _below(sizes: pd.Series) -> pd.Series:
    """Sums from every place of an array to its end."""
    return sizes.map(lambda s: np.cumsum(np.asarray(s, np.int64)[::-1])[::-1])


def trie(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of ``sequences`` (``conv_id``, ``seq`` of ``id`` and ``bytes``)."""
    top = _distinct(sequences).select(
        F.lit("").alias("box"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("above"), F.lit(None).cast("bigint").alias("parent_conv"),
        "ids", "bytes", "conv", "n", "ends")
    settled, heads = _burst(_written(top, "trie-top"), container)
    order = ["box", "ids"]
    columns = ["box", "depth", "above", "parent_conv", "ids", "bytes", "conv", "n", "ends"]
    boxes = settled[0]
    for more in settled[1:]:
        boxes = boxes.unionByName(more)
    swept = boxes.select(*columns).repartition("box").sortWithinPartitions(*order).mapInArrow(_sweep, f"{_NODE}, above array<string>")
    if not heads:
        return swept.drop("above")
    swept = _written(swept, "trie-swept")
    # A head's own turns: those of its chain, the first of them being the container's top.
    above = heads[0]
    for more in heads[1:]:
        above = above.unionByName(more)
    first = F.greatest(F.col("depth"), F.lit(1))
    above = _written(above.withColumn("sizes", F.transform(
        F.slice("bytes", first, F.greatest(F.col("until") - first + 1, F.lit(0))), lambda b: b * (F.col("n_convs") - 1))), "trie-above")
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    parts = swept.filter("above is not null").select(F.explode("above").alias("box"), "n_leaves", "saved_tokens").unionByName(
        above.select(F.explode("above").alias("box"), F.lit(0).cast("bigint").alias("n_leaves"), total.alias("saved_tokens")))
    sums = parts.groupBy("box").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    # The root has no turn of its own, so its chain starts with a size of zero.
    sizes = F.when(F.col("depth") == 0, F.concat(F.array(F.lit(0).cast("bigint")), "sizes")).otherwise(F.col("sizes"))
    chain = above.join(sums, "box").select("*", F.posexplode(F.pandas_udf(_below, "array<long>")(sizes)).alias("at", "own"))
    last = F.col("depth") + F.col("at") == F.col("until")
    nodes = chain.select(
        F.col("head_conv").alias("conv_id"), (F.col("depth") + F.col("at")).cast("int").alias("depth"),
        F.when(F.col("at") == 0, F.col("parent_conv")).otherwise(F.col("head_conv")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("below") + F.col("own")).alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(_NOTHING))).otherwise(F.lit(_NOTHING)).alias("ends_sha256"))
    return swept.drop("above").unionByName(nodes)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes = trie(rebuilt(turns))
    return nodes.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Prefixes spelled out: a running list of turn digests for every conversation and depth.  The crc32 table comes from its polynomial.
OP13_SQL = """
with recursive bits(byte, k, v) as (
    select i, 0, i::bigint from range(256) r(i)
    union all
    select byte, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bits where k < 8),
tab as (select list(v order by byte) as t from bits where k = 8),
own as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) as p,
        sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as id, coalesce(strlen(text), 0) as b
    from conversations where conv_id is not null),
convs as (
    select c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda s, x: xor(s // 256, t[(xor(s, x) % 256) + 1])), 4294967295) % 9 as h
    from (select distinct c from own), tab),
turns as (
    select c, p, id, b from own join convs using (c) where p > h
    union all
    select convs.c, p, id, b from own join convs on own.c = convs.c - convs.c % 5 where p <= h),
placed as (select c, row_number() over (partition by c order by p) as d, id, b from turns),
prefixes as (
    select c, d, sha256(string_agg(id, ',') over (partition by c order by d)) as key, b from placed
    union all select c, 0, '', 0 from convs),
whole as (select c, max(d) as d, max_by(key, d) as key from prefixes group by c),
ends as (select key, sha256(string_agg(c::varchar, ',' order by c)) as ends from whole group by key),
nodes as (select key, d, min(c) as c, count(*) as n, any_value(b) as b from prefixes group by key, d),
linked as (
    select nodes.*, p.key as up, pn.c as up_c from nodes
    left join prefixes p on p.c = nodes.c and p.d = nodes.d - 1 left join nodes pn on pn.key = p.key),
kids as (select up as key, count(*) as kids from linked where up is not null group by up),
sums as (
    select a.key, sum((kids.kids is null)::int) as leaves, sum((n.n - 1) * n.b) as saved
    from nodes n left join kids using (key) join prefixes a on a.c = n.c and a.d <= n.d group by a.key)
select l.c as conv_id, l.d::bigint as depth, l.up_c as parent_conv_id, l.n::bigint as n_convs, coalesce(kids.kids, 0)::bigint as n_children,
    s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from linked l join sums s using (key) left join kids using (key) left join ends e using (key)
"""
