"""Jaccard self-join of word shingles: rarity prefixes and differences from a common text.

Texts whose shingle sets are equal are one node first.  Every set shows the least ``LEAST_PREFIX`` of its shingles (tokens) by
hash; similar sets have so many of them in common that a set whose shown tokens hardly occur elsewhere is similar to none and is
left out.  Of the others the whole sets are made and the same is asked of all their tokens.

Sets that are similar enough share a token among the rarest ``n - need + 1`` of each, where ``need`` is the number of tokens that
both sizes call for; ``EXTENDED`` more tokens are shown and so many more must be shared.  Tokens are ordered by how many sets hold
them, so a passage of many texts is looked at only in texts that hold little else.

Groups of near copies do not yield all their pairs.  A set gets a base, the most central of the sets that share many of its tokens,
whose tokens are the most widespread, and is compared with it.  Linked sets become one cluster, and pairs are made
only between members of different clusters.  Two sets of one base are as far apart as their differences from it, the tokens that only one of set
and base has: similar sets of which one is not linked with the base must share many differences, so their pairs are found by the rarest of these.
Pairs of different bases are found by the rarest tokens.  Candidates are verified on the whole sets.

Defined results: null texts and texts without words have no shingles and no links; fewer words than ``k_words`` make one
shingle; rows with a null identifier are their own component (null); repeated identifiers are one node; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import map_frames, new_folder, private, settings, table
from lodefield.llm.components import components
from lodefield.llm.shingles import shingle_sets

K_WORDS = 5
PERCENT = 75
#: A token in more sets than this takes part in the choice of bases.
FREQUENT = 8
#: Sets show at least this many tokens at first; smaller sets show all.
LEAST_PREFIX = 160
#: Similar sets share so many tokens more in prefixes that are longer by so many.
EXTENDED = 2
#: Tokens are shortened to this many bits where sets first show them; whole sets keep 64.
_TOKEN_BITS = 48
_SETS_ROWS = 256


@lru_cache(maxsize=100_000)
def _shown(n: int, percent: int) -> tuple[int, int]:
    """How many tokens a set of ``n`` shows at first, and how many of them it has in common with any similar set's at least."""

    def length(m):
        return np.minimum(m, np.maximum(LEAST_PREFIX, m * (100 - percent) // 100 + 2 + m // 16))

    if not n:
        return 0, 0
    m = np.arange(-(-n * percent // 100), n * 100 // percent + 1)
    # Similar sets share ``need`` tokens; what a set does not show hides so many of them at most.
    need = -(-(n + m) * percent // (100 + percent))
    return int(length(n)), int((np.minimum(length(n) - n, length(m) - m) + need).min())


def _need(a: str, b: str, percent: int) -> Column:
    """Tokens that similar sets of sizes ``a`` and ``b`` have in common at least."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _node(tokens: np.ndarray) -> int:
    """Equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, k_words: int, columns: str, row) -> DataFrame:
    """``id`` and the ``columns`` that ``row`` makes of the sets of a few texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _SETS_ROWS):
                part = batch.iloc[at : at + _SETS_ROWS]
                yield pd.DataFrame({"id": part["id"], **row(shingle_sets(part["text"], k_words))})

    return map_frames(docs, run, f"id bigint, {columns}")


def sets_of(docs: DataFrame, k_words: int = K_WORDS, percent: int = PERCENT) -> DataFrame:
    """``id, node, n, least, shown``: the set's node and size, its first tokens by hash and how many of them similar sets share at least."""

    def row(sets: list[np.ndarray]) -> dict:
        plan = [_shown(len(s), percent) for s in sets]
        return {"node": [_node(s) for s in sets], "n": [len(s) for s in sets], "least": [least for _, least in plan],
                "shown": [(s[:length] >> np.uint64(64 - _TOKEN_BITS)).view(np.int64) for s, (length, _) in zip(sets, plan)]}

    return _sets(docs, k_words, "node bigint, n bigint, least bigint, shown array<bigint>", row)


def whole_sets(docs: DataFrame, k_words: int = K_WORDS) -> DataFrame:
    """``id, node, n, tokens``: the whole set as sorted 64-bit hashes."""

    def row(sets: list[np.ndarray]) -> dict:
        return {"node": [_node(s) for s in sets], "n": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]}

    return _sets(docs, k_words, "node bigint, n bigint, tokens array<bigint>", row)


# Let Spark filter the texts by a Bloom filter of the wanted identifiers before it shuffles them.
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def _repeated(postings: DataFrame, *of_token: str) -> DataFrame:
    """The postings of tokens with several ``rows``; they are shuffled once, for the count and for the join with it."""
    dealt = postings.repartition(*of_token)
    return dealt.join(dealt.groupBy(*of_token).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), list(of_token))


def _rarest(postings: DataFrame, *of_token: str) -> DataFrame:
    """``node, tokens`` (``rows, token``), the rarest first: those of a node's tokens that several rows have."""
    return _repeated(postings.select("node", *of_token), *of_token).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rows", "token"))).alias("tokens"))


def shared_sets(sets: DataFrame, docs: DataFrame, k_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``node, n, tokens`` (``rows, token``, the rarest first) of the sets that share enough tokens with others to be similar to any, and ``node, n, tokens`` with all tokens.

    The first ``tokens`` are those that several sets have; the ``n`` tokens less these are in no other set.
    """
    given = sets.filter("n > 0 and id is not null")
    # Copies count their tokens several times, which leaves out fewer.
    common = _repeated(given.select("node", F.explode("shown").alias("token")), "token").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    enough = common.join(given.groupBy("node").agg(F.first("least").alias("least"), F.min("id").alias("id")), "node").filter("common >= least")
    wanted = _written(enough.select("id").distinct(), "sharing-sets")
    least = wanted.agg(F.min("id")).first()[0]
    with settings(docs.sparkSession, _BLOOM):
        few = docs.join(wanted.filter(F.col("id") >= F.lit(least)), "id", "left_semi") if least is not None else docs.limit(0)
        whole = _written(whole_sets(few, k_words).filter("n > 0").drop("id"), "whole-sets")
    if not whole.groupBy("node").count().filter("count > 1").isEmpty():  # repeated identifiers
        whole = _written(whole.dropDuplicates(["node"]), "whole-sets")
    ordered = _rarest(whole.select("node", F.explode("tokens").alias("token")), "token").join(whole.select("node", "n"), "node")
    return _written(ordered.filter(F.size("tokens") * 100 >= F.col("n") * percent), "shared-sets"), whole


def _bases(shared: DataFrame, percent: int) -> DataFrame:
    """``node, base``: of the most central sets of a node's widespread tokens and its size, the one that shares most of them, if that is half its set.

    A set is central if most of its tokens are found in many others too, as in the text that copies were edited from.
    """
    wide = shared.withColumn("tokens", F.filter("tokens", lambda t: t["rows"] > FREQUENT)).filter(F.size("tokens") * 2 >= F.col("n"))
    spread = F.aggregate("tokens", F.lit(0.0), lambda s, t: s + F.log(t["rows"])) / F.size("tokens")
    # Two overlapping size classes, each as wide as sizes may differ and more.
    size = F.log("n") / F.log(F.lit(1.5))
    classes = F.array(2 * F.floor(size), 2 * F.floor(size + 0.5) + 1)
    sized = wide.select("node", "n", (F.size("tokens") / F.col("n")).alias("part"), spread.alias("spread"), F.explode(classes).alias("class"), "tokens").select(
        "node", "n", "part", "spread", "class", F.explode("tokens.token").alias("token"))
    sized = sized.repartition("token", "class")
    first = sized.groupBy("token", "class").agg(
        F.max_by(F.struct(F.col("node").alias("base"), F.col("n").alias("base_n")), F.struct("part", "spread", -F.col("node"))).alias("most"))
    met = sized.select("token", "class", "node", "n").join(first.select("token", "class", "most.*"), ["token", "class"])
    often = met.filter("node <> base").groupBy("node", "n", "base").agg(F.count_distinct("token").alias("common")).filter("common * 2 >= n")
    return often.groupBy("node").agg(F.max_by("base", F.struct("common", -F.col("base"))).alias("base"))


def _both(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``pairs`` with sizes and tokens of ``a`` and ``b`` and the number ``common`` that they share."""
    for tag, sets in (("a", a), ("b", b)):
        pairs = pairs.join(sets.select(F.col("node").alias(tag), F.col("n").alias(f"n_{tag}"), F.col("tokens").alias(f"tokens_{tag}")), tag)
    return pairs.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))


def verify(pairs: DataFrame, shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` that are linked: 100 * |a and b| >= percent * |a or b|."""
    pairs = _written(pairs.select("a", "b").distinct(), "candidates")
    return _written(_both(pairs, _plain(shared), _plain(shared)).filter(_linked(percent)).select("a", "b"), "links")


def _plain(shared: DataFrame) -> DataFrame:
    return shared.withColumn("tokens", F.col("tokens.token"))


def _linked(percent: int) -> Column:
    return F.col("common") >= _need("n_a", "n_b", percent)


def _side(postings: DataFrame, tag: str) -> DataFrame:
    return postings.select("token", *[F.col(c).alias(f"{c}_{tag}") for c in postings.columns if c != "token"])


def _placed(sets: DataFrame, *columns: str) -> DataFrame:
    """A row per token with its place ``at`` among the ``size`` tokens that are compared; those not in ``tokens`` are before them."""
    places = sets.select(*columns, "size", (F.col("size") - F.col("full")).alias("_before"), F.posexplode("tokens.token").alias("_at", "token"))
    return places.withColumn("at", F.col("_before") + F.col("_at")).drop("_before", "_at")


def _met(a: DataFrame, b: DataFrame, on: Column, need: Column) -> DataFrame:
    """The pairs of ``a`` and ``b`` that share enough of their rarest tokens to share ``need``."""
    more = F.least(F.lit(1 + EXTENDED), need)
    early = (F.col("at_a") < F.col("size_a") - need + more) & (F.col("at_b") < F.col("size_b") - need + more)
    met = _side(a, "a").join(_side(b, "b"), "token").filter(on & early)
    return met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), more.alias("more")).agg(
        F.count(F.lit(1)).alias("met")).filter("met >= more").select("a", "b")


def _links(shared: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that join all sets that are linked, directly or over others."""
    # A set and its base: whether they are linked, and which tokens only one of them has.  What only the base has is missing in all its sets.
    stars = _written(_bases(shared, percent).select(F.col("node").alias("a"), F.col("base").alias("b")), "bases")
    differ = F.concat(F.array_except("tokens_a", "tokens_b"), F.array_except("tokens_b", "tokens_a"))
    stars = _written(
        _both(stars, _plain(shared), whole).select(
            F.col("a").alias("node"), F.col("b").alias("base"), F.col("n_a").alias("n"), _linked(percent).alias("linked"),
            (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("size"), differ.alias("tokens")), "differences")
    links = stars.filter("linked").select(F.col("node").alias("a"), F.col("base").alias("b"))
    found = components(links)
    known = _written(
        shared.select("node").join(found, "node", "left").join(stars.select("node", "base"), "node", "left")
        .select("node", F.coalesce("component", "node").alias("cluster"), F.coalesce("base", "node").alias("base")), "clusters")
    need = _need("n_a", "n_b", percent)
    apart = (F.col("cluster_a") != F.col("cluster_b")) & (need <= F.least("n_a", "n_b"))

    # Pairs of different bases by their rarest tokens.  A set shows as many as its smallest similar set calls for.
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    full = F.size("tokens")
    prefixes = shared.join(known, "node").select(
        "node", "cluster", "base", "n", F.col("n").alias("size"), full.alias("full"),
        F.slice("tokens", F.lit(1), full - least + 1 + EXTENDED).alias("tokens"))
    prefixes = _written(_placed(prefixes, "node", "cluster", "base", "n"), "prefixes")
    pairs = _met(prefixes, prefixes, apart & (F.col("node_a") < F.col("node_b")) & (F.col("base_a") != F.col("base_b")), need)

    # Pairs of one base by their rarest differences from it.  The differences of two sets are as far from each other as the sets, so
    # similar sets share half of what theirs have together and the sets may not.  That is less than one only if both sets are linked with
    # the base.  A set that is linked with it shares p / (1 + p) of its differences with any similar set that is not; one that
    # is not linked shares all but as many as a similar set may be away.
    kept = ["node", "base", "n", "linked", "size"]
    parts = _rarest(stars.select("node", "base", F.explode("tokens").alias("token")), "base", "token").join(stars.select(kept), "node")
    least = F.when(F.col("linked"), F.ceil(F.col("size") * percent / (100 + percent))).otherwise(
        F.greatest(F.lit(1), F.col("size") - F.floor(F.col("n") * (100 - percent) / percent)))
    shown = F.greatest(F.lit(0), full - least + 1 + EXTENDED).cast("int")
    parts = parts.withColumn("full", full).withColumn("tokens", F.slice("tokens", F.lit(1), shown)).join(known.select("node", "cluster"), "node")
    parts = _written(_placed(parts, "node", "cluster", "base", "n", "linked"), "difference-prefixes")
    differing = F.ceil((F.col("size_a") + F.col("size_b") - (F.col("n_a") + F.col("n_b") - 2 * need)) / 2)
    once = F.col("linked_b") | (F.col("node_a") < F.col("node_b"))
    near = _met(parts.filter("not linked"), parts, apart & (F.col("base_a") == F.col("base_b")) & once, differing)
    return links.unionByName(verify(pairs.unionByName(near), shared, percent))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k_words: int = K_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = _written(sets_of(texts, k_words, percent), "sets")
    given = sets.filter("n > 0 and id is not null")
    groups = _written(given.groupBy("node").agg(F.min("id").alias("rep")), "groups")
    # The sets of a repeated identifier are one node.
    repeated = given.groupBy("id").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    same = given.join(repeated, "id").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = components(_links(*shared_sets(sets, texts, k_words, percent), percent).unionByName(same))
    linked = found.join(groups, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    owner = linked.join(least, "component").select("node", "least")

    member = sets.select("id", "n", "node").join(groups, "node", "left").join(owner, "node", "left")
    own = F.when(F.col("n") > 0, F.coalesce("least", "rep", "id")).otherwise(F.col("id"))
    return member.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which no linked document has a smaller identifier; rows with a null identifier stay."""
    found = near_components(docs, id_col, text_col)
    name = private(docs, "_dropped")
    dropped = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col(id_col) == F.col(name), "left_anti")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for all documents."""
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
