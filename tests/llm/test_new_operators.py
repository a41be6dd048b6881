"""Language identification, vector codes and the conversation trie against brute force, with the edge cases their docstrings state."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefield.llm import conversation_trie, language_id, vector_codes

BIG = 2**53 + 1


# 11: language identification

def letter_sequences(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return sum(1 for w in words for k in range(1, 5) for i in range(len(w) + 3 - k) if f" {w} "[i : i + k] != " ")


@pytest.mark.parametrize("text", ["", "12 !!", "a", "Hello, world 12abc", "Über x", " x", "東京", "x" * 1000])
def test_letter_sequences_are_counted(text):
    assert language_id.counts_of(text).sum() == letter_sequences(text)


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = "Hello, world 12abc quick brown " * 40
    whole = language_id.counts_of(text)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert (language_id.counts_of(text) == whole).all()


def test_votes_margins_and_names_decide():
    model = language_id.LanguageModel(("f", "g"), (("a", "b", "c"), ("d",)), (("a", "b"), ("a", "c"), ("b", "c")), np.empty((0, 5)), np.zeros(5))
    lang, score = model.predict(np.array([
        [5, 0, 1.0, 1, 1], [5, 0, 1, -3, 1], [5, 0, 1, -1, 1], [0, 5, 1, 1, 1], [5, 0, 0, 0, 0]], float))
    # Two votes; one vote each and the largest margins; one vote each and equal margins; a family of one; all equal.
    assert list(lang) == ["a", "c", "a", "d", "a"] and ((score >= 0) & (score <= 1)).all()
    assert score[3] == pytest.approx(1 / (1 + np.exp(-5)))


def test_held_out_languages_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    found = language_id.identify(docs).join(docs, "doc_id").toPandas()
    want = [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]
    assert list(found.held_out) == want
    assert (found.lang == found.lang_pred)[found.held_out].mean() > 0.97 and found.score.between(0, 1).all()


def test_language_edge_cases(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id < 120").withColumn("doc_id", F.col("doc_id") + 10)
    odd = [(None, "the house and the", "xx"), (BIG, None, "en"), (1, "", "en"), (2, "123 ++ 4", "de"), (3, "x" * 300_000, None), (3, "x" * 300_000, None)]
    rows = known.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, lang string")).withColumn("score", F.lit(7)).withColumn("a.b", F.lit(1))
    got = language_id.identify(rows).filter("doc_id is null or doc_id < 10 or doc_id > 1000").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[BIG].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[1].score == 0
    assert by[None].lang_pred in ("de", "en", "es", "fr") and by[None].held_out is False and by[3].lang_pred != "und"
    nothing = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(nothing).collect()] == [("und", 0.0)]
    assert language_id.identify(nothing.limit(0)).count() == 0
    only = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(9)], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(only).collect()} == {("en", 1.0)}


# 12: vector codes

@pytest.mark.parametrize("n,width,size", [(256, 16, 400), (256, 16, 2), (5, 2, 2), (1, 3, 9), (40, 4, 1 << 26), (3, 0, 1)])
def test_orchard_search_finds_the_nearest(n, width, size):
    rng = np.random.default_rng(3)
    entries, x = (rng.integers(-size, size + 1, (k, width)) for k in (n, 2000))
    found, least = vector_codes.Orchard(entries).search(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def brute_codes(rows, parts, entries, rounds):
    """Codes and errors by id, in Python's whole numbers."""
    rows = sorted((i, [min(max(int(np.floor(c * 1024)), -(1 << 26)), 1 << 26) for c in v]) for i, v in rows)
    step = len(rows[0][1]) // parts
    cut = [[v[p * step : (p + 1) * step] for _, v in rows] for p in range(parts)]
    books = [[list(v) for v in column[:entries]] for column in cut]

    def nearest(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for book, column in zip(books, cut):
            members = defaultdict(list)
            for v in column:
                members[nearest(book, v)[1]].append(v)
            for k, group in members.items():
                book[k] = [sum(c) // len(group) for c in zip(*group)]
    out = {}
    for r, (i, _) in enumerate(rows):
        best = [nearest(book, column[r]) for book, column in zip(books, cut)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return out, books


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(c) for c in rng.normal(0, 1, 8)]) for i in [*range(60), BIG, BIG + 2]]
    want, books = brute_codes(rows, 4, 12, 4)
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, code int")
    coded, found = vector_codes.compress(frame, entries=12)
    assert {r.row.vec_id: (r.code, r.error) for r in coded.collect()} == want
    assert found.sha256 == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    # A code stands for the entries it names.
    decoded = coded.select("row.vec_id", found.decode(F.col("code")).alias("v"), "code").collect()
    assert all(r.v == [c for p, b in enumerate(books) for c in b[int(r.code[2 * p : 2 * p + 2], 16)]] for r in decoded)


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2, 0.3, 0.4], "x"), (2, [0.1, 0.2, 0.3, 0.4], None), (None, [0.5, 0.0, 0.0, -1e300], None), (2, [9.0, 9.0, 9.0, 9.0], "x"),
        (3, None, "x"), (4, [nan, 0.0, 0.0, 0.0], "x"), (5, [inf, 0.0, 0.0, 0.0], "x"), (6, [None, 0.0, 0.0, 0.0], "x"), (7, [1.0], "x"), (8, [], "x"),
        (BIG, [0.1, 0.2, 0.3, 0.4], "x")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").withColumn("a.b", F.lit(1)).withColumn("error", F.lit("e"))
    coded, books = vector_codes.compress(frame)
    got = vector_codes.with_label_error(coded.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), "code", "error"), F.col("label")).collect()
    by = Counter((r.vec_id, r.code) for r in got)
    # Five vectors of four components make five entries; other lengths stay without a code.
    assert by == Counter([(1, "00000000"), (2, "00000000"), (2, "02020202"), (BIG, "00000000"), (None, "04040404"), (7, None), (8, None)])
    assert {r.error for r in got} == {0, None} and {r.label_error for r in got} == {0}
    assert len(books.books[0]) == 5
    for odd in (frame.limit(0), frame.filter("vec_id = 7"), frame.filter("vec_id = 3")):
        coded, _ = vector_codes.compress(odd)
        assert [r.code for r in coded.collect()] == [None] * odd.filter("vec_id = 7").count()


# 13: conversation trie

def brute_trie(turns):
    """Nodes by prefix, in Python."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + seq[h:])
    nodes = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            nodes[full[c][:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    return {(m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in m if full[c] == p).encode()).hexdigest()) for p, m in nodes.items()}


TURNS = "conv_id bigint, turn bigint, role string, text string"


def nodes_of(spark, turns, container):
    frame = spark.createDataFrame(turns, TURNS).withColumn("seq", F.lit(1)).withColumn("a.b", F.lit(2))
    rows = conversation_trie.trie(conversation_trie.rebuilt(frame), container).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("container", [1, 30, 10_000])
def test_trie_equals_brute_force(spark, container, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    rng = np.random.default_rng(4)
    turns = [(c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["é", "b", "", "cc"]))) for c in range(40) for t in range(int(rng.integers(1, 12)))]
    # A long beginning that several share, copies, and texts that only differ late.
    for c in range(100, 112):
        turns += [(c, t, "user", f"same {t}") for t in range(30)] + [(c, 30 + t, "user", str(rng.integers(0, 2))) for t in range(c % 4)]
    turns += [(c, t, "system", "copy") for c in range(200, 240) for t in range(3)]
    assert nodes_of(spark, turns, container) == brute_trie(turns)


def test_trie_edge_cases(spark):
    turns = [
        (None, 1, "user", "lost"), (5, None, "user", "first"), (5, 2, None, None), (5, 2, None, None), (5, 1, "", ""), (-7, 1, "user", "x" * 200_000),
        (-7, 1, "assistant", "tie"), (BIG, 1, "user", "big"), (BIG + 1, 1, "user", "big"), (11, 0, "a", "bc"), (16, 0, "ab", "c")]
    assert nodes_of(spark, turns, 2) == brute_trie(turns)
    assert conversation_trie.trie(conversation_trie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    # A conversation that keeps no turn of its own ends at the root.
    short = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    (root,) = nodes_of(spark, [(short, 0, "user", "gone")], 5)
    assert root[:7] == (short, 0, None, 1, 0, 1, 0) and root[7] == hashlib.sha256(str(short).encode()).hexdigest()
