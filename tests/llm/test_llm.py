"""Operators of the subpackage against brute force on small tables, with the edge cases their docstrings state."""

import base64
import bisect
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodefield.llm import (
    components, embedding_join, exact_dedup, line_dedup, ngram_join, packing, pieces, quality, queries, shingles, toxicity, url_filter, warc,
)

DOCS = "doc_id bigint, text string, lang string, source string, keep_id string, score string"
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def docs(spark, texts, first=1):
    rows = [(i, t, "en", f"s{i % 3}", "x", "y") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_TO_Z))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


EDGE = [None, "", " \n\t", "a", "A a", "one two three four five", "One two THREE four five", "é ß x y z w v", "x " * 3000]


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.sql(queries.ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    got, want = (x.astype(object).where(x.notna(), None).sort_values(key, key=lambda c: c.astype(str), ignore_index=True) for x in (got, want))
    assert len(got) == len(want)
    for c in key:
        assert [a == b for a, b in zip(got[c], want[c])] == [True] * len(got), c


# Shingles and components

def test_shingle_sets_count_as_brute_force():
    assert [len(s) for s in shingles.shingle_sets(EDGE)] == [len(s) for s in brute_sets(EDGE)]
    a, b = shingles.shingle_sets(["a b c d e f", "A b c d e  f"])
    assert (a == b).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 10 for i in range(10, 41)) and all(found[i] == 100 for i in range(100, 120)) and 5 not in found


# 6: n-gram Jaccard join

def check_join(spark, texts):
    sets = brute_sets(texts)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(len(texts), pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs(spark, texts, 0)).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    return pairs


def test_join_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    words = [f"w{i}" for i in range(4000)]
    passage = [f"p{i}" for i in range(60)]
    texts = list(EDGE)
    for size in (12, 50, 200, 700):
        base = list(rng.choice(words, size))
        for _ in range(12):  # near copies of different distances, some without any word in common
            changed = list(base)
            for at in rng.integers(0, size, int(rng.integers(0, max(2, size // 25)))):
                changed[at] = str(rng.choice(words))
            texts.append(" ".join(changed))
    for _ in range(12):  # a passage of many texts, most of each text
        texts.append(" ".join([*passage, *rng.choice(words, int(rng.integers(3, 30)))]))
    texts += [texts[12], texts[12].upper()]
    assert len(check_join(spark, texts)) > 50


def test_join_of_nothing(spark):
    assert ngram_join.near_components(docs(spark, [])).count() == 0
    kept = ngram_join.keep_first(docs(spark, [None, "", "a b c d e f", "a b c d e f", "x"]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5] and kept.columns[-1] == "score"


# 10: exact dedup

def test_exact_dedup_edge_cases(spark):
    table = docs(spark, ["A b", "a B", None, "", "ä", "Ä", "x" * 200_000, "x" * 200_000]).unionByName(docs(spark, ["A b"], 2))
    _, decided = exact_dedup.deduplicate(table)
    rows = {(r.id, r.row): r for r in decided.collect()}
    assert len(rows) == 9 and sum(r.kept for r in rows.values()) == 5
    assert {r.id for r in rows.values() if r.kept} == {2, 4, 5, 6, 8}
    assert sorted(r.group_size for r in rows.values()) == [1, 1, 2, 2, 2, 2, 3, 3, 3]
    kept = exact_dedup.keep_one(table)
    assert kept.columns == table.columns and kept.count() == 5
    assert exact_dedup.keep_one(docs(spark, [])).count() == 0


def test_exact_dedup_compares_full_texts(spark):
    texts = ["apple", "avocado", "Apple", "banana", "b"]
    _, decided = exact_dedup.deduplicate(docs(spark, texts), digest=lambda t: F.substring(t, 1, 1).cast("binary"))
    assert {r.id: r.keep_id for r in decided.collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_exact_dedup_state_grows_with_later_batches(spark, tmp_path):
    data, state = str(tmp_path / "in"), str(tmp_path / "state")
    part = lambda rows: spark.createDataFrame(rows, "digest binary, id bigint, row bigint")
    stream = None
    for rows in ([(b"a", 1, 1), (b"b", 2, 2)], [(b"a", 5, 3), (b"c", 3, 4)]):
        part(rows).write.mode("append").parquet(data)
        stream = spark.readStream.schema(part(rows).schema).parquet(data)
        exact_dedup.observe(stream, state)
    found = {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.known(spark, state).collect()}
    assert found == {b"a": (5, 2), b"b": (2, 1), b"c": (3, 1)}


# 7: URL filter

def test_url_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/", "http://b.net/es/1", "http://net/fr/", "x.com", None, "http://a.com", "http://a.com?x/y", "s://u@h.org:80#t"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(8, True), (2, False), (7, None)], "page_id bigint, good boolean")
    rows = {r.page_id: r for r in url_filter.judge(pages, outcomes).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(9)] == [
        ("www.example.com", "/en/x", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("b.net", "/es/1", "net/es/"),
        ("net", "/fr/", "net/fr/"), ("", "", None), ("", "", None), ("a.com", "", None), ("a.com", "", None), ("u@h.org:80", "", None)]
    assert [rows[i].verdict for i in range(4)] == ["allow", "block", "block", "block"]
    assert url_filter.judge(pages.limit(0), outcomes.limit(0)).count() == 0


def test_reputation_shrinks_towards_domain(spark):
    rows = [("a.x.org", True)] * 30 + [("b.x.org", True)] * 20 + [("c.y.org", False)] * 40 + [("d.z.net", True)] * 2
    found = {r.host: r for r in url_filter.reputation(
        spark.createDataFrame([(h,) for h in ("a.x.org", "new.x.org", "c.y.org", "new.y.org", "q.info")], "host string"),
        spark.createDataFrame(rows, "host string, good boolean")).collect()}
    assert found["new.x.org"].rate > found["q.info"].rate > found["new.y.org"].rate
    assert found["a.x.org"].bound > found["new.x.org"].bound and found["new.x.org"].n == 0


# 3: WARC

def test_warc_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nä\r\n\r\n"
    rows = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "u", tricky), (6, "u", "y" * 300_000), (7, "u", "same"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_archives(warc.resolve(pages), folder, records_per_file=3)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == 8
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[i].record_type == "revisit" or bytes(got[i].payload) == raw
    assert {i: got[i].refers_to for i in (1, 2, 3, 4, 7, None)} == {1: None, 2: 1, 3: None, 4: 3, 7: 1, None: None}
    big = warc.resolve(pages, min_bytes=5)
    assert {r.record_type for r in big.collect()} == {"response"}
    warc.write_archives(warc.resolve(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


# 5: packing

def plain_best_fit(counts, size):
    left = []
    for c in sorted(counts, reverse=True):
        for _ in range(counts[c]):
            at = bisect.bisect_left(left, c)
            bisect.insort(left, (left.pop(at) if at < len(left) else size) - c)
    return len(left)


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(1)
    counts = {int(c): int(n) for c, n in zip(range(1, 65), rng.integers(0, 40, 64))}
    for score in ("norm", "dot"):
        for docs_cap, cost in ((64, 64.0**2), (3, 64.0**2), (64, 1500.0)):
            counted = {c: n for c, n in counts.items() if c * c <= cost}
            plan = packing.best_fit(counted, lambda c: (c, 1, c * c), (64, docs_cap, cost), score=score)
            bins = {}
            for c, n in counted.items():
                for rank in range(n):
                    at = np.searchsorted(plan.key, (c << 44) | rank, side="right") - 1
                    within = rank - int(plan.key[at] & ((1 << 44) - 1))
                    bins.setdefault(int(plan.first_bin[at] + within // plan.per_bin[at]), []).append((int(plan.offset[at] + within % plan.per_bin[at] * c), c))
            assert len(bins) == plan.bins
            for items in bins.values():
                items.sort()
                assert [o for o, _ in items] == [sum(c for _, c in items[:k]) for k in range(len(items))]
                assert sum(c for _, c in items) <= 64 and len(items) <= docs_cap and sum(c * c for _, c in items) <= cost
            if score == "norm" and (docs_cap, cost) == (64, 64.0**2):
                assert plan.bins <= plain_best_fit(counted, 64) * 1.005 + 1


def test_lines_within_six_errors_of_the_threshold_are_counted(spark):
    error = 1.04 / 64
    assert line_dedup._margin(8, 12) == 1 and all(line_dedup._margin(n, 12) >= 6 * error * n for n in (8, 100, 400, 5000))
    # A coarse sketch decides as the exact count does.
    rows = [(f"s{i}", f"line {n}") for n in range(36, 45) for i in range(n)]
    given = spark.createDataFrame(rows, "source string, text string")
    assert line_dedup.boilerplate(given, min_sites=40, lg_k=6).count() == 5


def test_packed_pieces_hold_every_token(spark, sf):
    vocabulary = packing.public_vocabulary()
    texts = [*EDGE, "word " * 5000, "<|endoftext|> in a text", "日本語 🙂\u2028x"]
    found, placed = packing.pack(docs(spark, texts).unionByName(docs(spark, [None], 1)))
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary.json)
    want = [*(exact.encode(t or "", add_special_tokens=False).ids + [2] for t in texts), [2]]
    rows = found.collect()
    assert sum(r.length for r in rows) == sum(map(len, want))
    for i, ids in enumerate(want[1:-1], 2):
        mine = sorted((r.piece, r.start, r.length, list(r.ids), r.ids_crc32) for r in rows if r.doc_id == i)
        assert [x for m in mine for x in m[3]] == ids and all(m[2] == 1024 for m in mine[1:])
        assert all(m[4] == zlib.crc32(np.array(m[3], "<u4").tobytes()) for m in mine)
    bins = {}
    for r in placed.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(n for _, n in items) <= 1024
    assert len(bins) <= -(-sum(map(len, want)) // 1024) + 1
    assert packing.pack(docs(spark, []))[1].count() == 0


def test_two_encoders_agree(spark, sf):
    from tokenizers import Tokenizer

    vocabulary = packing.public_vocabulary()
    exact = Tokenizer.from_file(vocabulary.json)
    for (text,) in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall():
        assert packing.encode(text, vocabulary).tolist() == exact.encode(text or "", add_special_tokens=False).ids


# 2: line dedup

def test_lines_of_many_sites_go(spark):
    rows = [(i, f"own {i}\n common \n\nrare\r\nown too {i}", f"s{i}") for i in range(9)] + [(20, None, "s1"), (21, "common", None), (22, "", "s2")]
    rows = [(i, t.replace("rare", "rare" if i < 7 else "rarer") if t else t, s) for i, t, s in rows]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_lines", F.lit("own"))
    out = {r.doc_id: r for r in line_dedup.remove_boilerplate(table).collect()}
    assert out[0].clean_text == "own 0\n\nrare\r\nown too 0" and (out[0].n_lines, out[0].n_removed) == (4, 1)
    assert out[20].clean_text is None and out[20].n_lines == 0 and out[21].clean_text == "" and out[22].clean_text == ""
    assert line_dedup.remove_boilerplate(table.limit(0)).count() == 0


# 1 and 4: classifiers

@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("an", "re", "ti", "on") for b in ("der", "than", "sol", "mir", "pet")]
    rows, marks = [], []
    for i in range(1200):
        text = list(rng.choice(plain, int(rng.integers(5, 80))))
        toxic, poor = int(rng.random() < 0.15), int(rng.random() < 0.15)
        if toxic:
            text += list(rng.choice(["idiot", "zugplonk", "zugmare", "zugtell"], int(rng.integers(1, 4))))
        if poor:
            text = [w + "%%%" for w in text]
        rows.append((i, " ".join(rng.permutation(text)), "q"))
        marks.append((i, 1 - poor, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_toxicity_finds_held_out_texts(spark, labelled):
    table, labels = labelled
    model = toxicity.train(table, toxicity.learnable(labels))
    out = toxicity.score(table.select("doc_id", "text"), model).toPandas().merge(labels.toPandas(), on="doc_id")
    out = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert ((out.score >= 0.5).astype(int) == out.toxic).mean() > 0.97
    assert toxicity.learnable(labels).filter("pmod(crc32(cast(doc_id as string)), 5) = 0").count() == 0
    assert model.label_model.accuracy()[0] > 0.9
    kept = toxicity.keep_clean(table, toxicity.learnable(labels))
    assert kept.columns == table.columns and 900 < kept.count() < 1100 and kept.first().score == "q"


def test_label_model_corrects_flipped_labels():
    """A tenth of the labels is wrong; three independent voters and a copy of one of them move most of them back."""
    rng = np.random.default_rng(8)
    true = (rng.random(4000) < 0.12).astype(int)
    given = np.where(rng.random(4000) < 0.1, 1 - true, true)
    voters = [np.where(rng.random(4000) < np.where(true == 1, hit, false), 1, 0) for hit, false in ((0.8, 0.02), (0.7, 0.01), (0.75, 0.05))]
    votes = np.column_stack([given, *voters, voters[0]])
    model = toxicity.fit_label_model(votes, np.where(given == 1, 0.95, 0.02))
    wrong = ((model.posterior(votes) >= 0.5) != true).mean()
    assert (given != true).mean() > 0.08 and wrong < 0.02
    assert abs(model.share - true.mean()) < 0.02
    # The label's rates were learned: 0.1 and 0.9, not the prior's.
    assert np.abs(model.rate[:, :, 0].mean(axis=1) - [0.1, 0.9]).max() < 0.04


def test_posterior_equals_the_joint_probability():
    """Every combination of four votes, by multiplying the probabilities of the tree."""
    rng = np.random.default_rng(3)
    parent, rate = (-1, 0, 1, 0), rng.uniform(0.05, 0.95, (2, 2, 4))
    model = toxicity.LabelModel(0.3, parent, rate)
    every = np.array(list(itertools.product((0, 1), repeat=4)))
    for row, got in zip(every, model.posterior(every)):
        joint = [0.7, 0.3]
        for y in (0, 1):
            for j, p in enumerate(parent):
                fires = rate[y, row[p] if p >= 0 else 0, j]
                joint[y] *= fires if row[j] else 1 - fires
        assert got == pytest.approx(joint[1] / sum(joint))


def test_quality_orders_grades(spark, labelled):
    table, labels = labelled
    out = quality.grade(table, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert ((out.reaches >= 0.5).astype(int) == out.quality).mean() > 0.98
    mean = out.groupby(["quality", "toxic"]).expected_grade.mean()
    assert mean[0, 0] < 0.3 and mean[0, 0] < mean[1, 1] < mean[1, 0] and mean[1, 0] > 1.7
    assert quality.keep_good(table, labels).columns == table.columns


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 1))
    grade = np.digitize(x[:, 0] + rng.logistic(scale=0.3, size=600), [-1, 0, 1])
    weights, thresholds = quality.fit_ordinal(x, grade, 4)
    assert (np.diff(thresholds) > 0).all() and weights[0] > 1.5 and np.abs(thresholds / weights[0] - [-1, 0, 1]).max() < 0.3


def test_classifiers_without_labels_or_rows(spark, labelled):
    table, labels = labelled
    odd = docs(spark, EDGE).select("doc_id", "text")
    model = toxicity.train(odd, toxicity.learnable(labels.limit(0)))
    assert max(r.score for r in toxicity.score(odd, model).collect()) < 1e-9
    assert quality.keep_good(odd, labels.limit(0)).count() == len(EDGE)
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.learnable(nulls).count() == 0 and quality.grades_of(nulls).count() == 0
    assert quality.grade(odd.limit(0), labels).count() == 0


# Identifiers and further columns

BIG = 2**53 + 1  # the first whole number that a double cannot hold
HARD_IDS = [BIG, None, BIG - 1, 7, -BIG]
ODD_COLUMNS = ["_text", "score", "_score_own", "_toxicity", "_QUALITY", "_dropped", "a.b", "marks", "then"]


@pytest.fixture(scope="module")
def hard(spark):
    """Ids beside a null, and columns with names and types that get in the way."""
    words = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4)]
    rows = list(zip(HARD_IDS, [words[0], words[1], words[2], words[1], words[3]]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    return df.select(
        "doc_id", "text", *[F.lit("own").alias(c) for c in ODD_COLUMNS[:7]], F.create_map(F.lit("k"), F.col("doc_id")).alias("marks"),
        F.lit("1500-01-01 00:00:00").cast("timestamp").alias("then"))


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=str)


def test_ids_beside_nulls_stay_whole(spark, hard, labelled, tmp_path):
    want = sorted(HARD_IDS, key=str)
    table, labels = labelled
    model = toxicity.train(table, toxicity.learnable(labels))
    assert ids(toxicity.score(hard.drop("score"), model)) == ids(quality.grade(hard, labels)) == want
    pieces_, places = packing.pack(hard)
    assert ids(pieces_) == ids(places) == want
    joined = {r.doc_id: r.component_id for r in ngram_join.near_components(hard).collect()}
    assert joined == {i: i for i in HARD_IDS}  # the null's twin, 7, does not lend it a component
    vectors = spark.createDataFrame(
        [(i, v, "l") for i, v in zip(HARD_IDS, ([1.0, 0.0], [1.0, 1.0], [1.0, 2.0], [1.0, 1.0], [-1.0, 0.0]))], "vec_id bigint, embedding array<double>, label string")
    near = {r.vec_id: r.component_id for r in embedding_join.near_vectors(vectors.coalesce(1)).collect()}
    assert near == {BIG: BIG, None: None, BIG - 1: BIG - 1, 7: 7, -BIG: -BIG}
    pages = spark.createDataFrame([(i, None if i is None else f"http://a/{i}", "same " * 10) for i in HARD_IDS], "page_id bigint, url string, html string")
    warc.write_archives(warc.resolve(pages.coalesce(1)), str(tmp_path / "archive"))
    back = warc.read_archives(spark, str(tmp_path / "archive"))
    assert ids(back, "page_id") == want and {r.refers_to for r in back.collect()} == {None, -BIG}


def test_stages_leave_further_columns_alone(hard, labelled):
    _, labels = labelled
    for keep in (lambda d: quality.keep_good(d, labels), lambda d: toxicity.keep_clean(d, toxicity.learnable(labels)), ngram_join.keep_first):
        out = keep(hard)
        assert out.columns == hard.columns and out.dtypes == hard.dtypes
        rows = out.drop("then").collect()
        assert len(rows) == 5 and all(r["a.b"] == r["score"] == r["_QUALITY"] == "own" for r in rows)
        assert sorted((r.doc_id for r in rows), key=str) == sorted(HARD_IDS, key=str)
        assert all(r.marks == {"k": r.doc_id} for r in rows) and out.filter("year(then) = 1500").count() == 5


# 9: vectors

def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 12))
    rows = []
    for i in range(700):
        v = base[rng.integers(25)] + rng.normal(size=12) * rng.choice([0, 0.05, 0.15, 0.22])
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 2), "x"))
    odd = [(900, None), (901, [0.0] * 12), (903, [float("nan")] + [1.0] * 11), (906, [None] + [1.0] * 11), (907, [])]
    rows += [(i, v, 1, "x") for i, v in odd] + [(902, rows[0][1], None, "x"), (904, [1.0] * 3, 1, "x"), (905, [2.0] * 3, 1, "x"), (None, rows[1][1], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, raw string").repartition(5)
    got = {r.vec_id: r for r in embedding_join.near_vectors(table).collect()}
    v = np.array([r[1] for r in rows[:700]])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = (u @ u.T >= 0.98) & (np.arange(700)[:, None] % 2 == np.arange(700) % 2)
    np.fill_diagonal(close, False)
    root = roots(700, zip(*np.nonzero(close)))
    assert close.sum() > 1000
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(700)] == [(int(close[i].sum()), root[i], root[i] == i) for i in range(700)]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 906, 907))
    assert (got[904].n_links, got[905].component_id) == (1, 904) and got[None].n_links == 0
    assert embedding_join.near_vectors(table.limit(0)).count() == 0


# 8: pieces

def test_lattice_gives_the_best_sum(spark):
    model_file = pieces.public_model()
    table, longest, byte_zero, unknown = pieces.piece_table(spark, model_file)
    known = {r.piece: (r.score, r.piece_id) for r in table.collect()}
    words = ["▁the", "▁lere", "▁Größe", "▁▁x", "▁日本\U0001f642", "▁antidisestablishmentarianism"]
    got = {r.word: list(r.ids) for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table, longest, byte_zero, unknown).collect()}
    score_of = {i: s for s, i in known.values()}
    for w in words:
        best = [0.0]
        for end in range(1, len(w) + 1):
            best.append(max(best[at] + known[w[at:end]][0] if w[at:end] in known else best[at] + unknown if end - at == 1 else -1e18
                            for at in range(max(0, end - longest), end)))
        odd = sum(1 for c in w if c not in known)
        held = [i for i in got[w] if i in score_of]
        assert sum(score_of[i] for i in held) + odd * unknown == pytest.approx(best[-1])


def test_pieces_round_trip(spark):
    texts = [*EDGE, " two  spaces ", "line\nbreak\ttab", "🙂 ﷽ ñandú", "▁ itself".replace("▁", "_")]
    encoded = pieces.encode(docs(spark, texts), pieces.public_model())
    assert {"doc_id", "keep_id", "ids"} <= set(encoded.columns)
    back = {r.doc_id: r.text for r in pieces.decode(encoded, pieces.public_model(), "doc_id").collect()}
    assert [back[i] for i in range(1, len(texts) + 1)] == texts


def test_op8_decodes_every_document(spark, tmp_path):
    import hashlib

    texts = [*EDGE, " two  spaces ", "long text, line\n" * 20_000, "a \u2581 b", None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in pieces.op8_pieces(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts, 1):
        # U+2581 stands for a space in the ids and comes back as one.
        back = None if t is None else t.replace("\u2581", " ")
        assert rows[i].decoded_sha256 == (None if t is None else hashlib.sha256(back.encode()).hexdigest())
        assert rows[i].round_trip == (None if t is None else back == t)
    assert [i for i, r in rows.items() if r.round_trip is False] == [len(texts) - 1]

def test_words_are_cut_where_no_piece_crosses(spark):
    import pyarrow as pa

    table, longest, byte_zero, unknown = pieces.piece_table(spark, pieces.public_model())
    known = {r.piece for r in table.collect()}
    cut = pieces._cutter(sorted(known))
    words = ["der", "", "x\ny" * 3, "  two", "日本\U0001f642語", "antidisestablishmentarianism", "\n", "日" * 5_000]
    parts, sizes = cut(pa.array(words))
    at, parts = 0, parts.to_pylist()
    for word, n in zip(words, sizes):
        whole, ends = (" " + word).replace(" ", pieces.SPACE), set()
        assert "".join(parts[at:at + n]) == whole
        for part in parts[at:at + n]:
            ends.add(len(part) + max(ends, default=0))
        crossed = {k for a in range(len(whole)) for b in range(a + 2, min(len(whole), a + longest) + 1) if whole[a:b] in known for k in range(a + 1, b)}
        assert not crossed & ends
        at += n
    assert max(map(len, parts)) < 40  # a long word of signs without joint pieces is not folded whole
    found = pieces._words(pa.array([None, "", "a b", " a  b ", "c▁d"])).to_pylist()
    assert found == [None, [], ["a", "b"], [" a", " b", ""], ["c", "d"]]


def test_pieces_of_rare_words_are_joined(spark):
    texts = [*EDGE, "one two\nthree 42 " + "x" * 90, "one two\nthree 42", "one two\nthree 42", "two\r\n\tone 7b7"]
    given = docs(spark, texts)
    every = {r.doc_id: r.ids for r in pieces.encode(given, pieces.public_model()).collect()}
    for most in (0, 2):
        assert {r.doc_id: r.ids for r in pieces.encode(given, pieces.public_model(), most_words=most).collect()} == every


# Pipeline

def test_pipeline_keeps_columns_and_packs_what_stays(spark, sf):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "exact dedup", "n-gram Jaccard join", "best-fit packing"]
    given = spark.read.parquet(f"{sf}/documents.parquet")
    left, kept = given, {r.doc_id for r in given.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, sf).toPandas(), given.schema)
        now = {r.doc_id for r in left.select("doc_id").collect()}
        assert now <= kept and left.columns == given.columns
        kept = now
    texts = [r.text for r in left.select("text").collect()]
    sets = brute_sets(texts)
    assert not any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a, b in itertools.combinations(sets, 2))
    packed = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept and 0 < len(kept) < given.count()


def test_every_query_without_sql_runs(spark, sf):
    rows = pd.Series({name: query(spark, sf).count() for name, query in queries.QUERIES.items() if name not in queries.ORACLES})
    assert (rows > 0).all() and rows["op1_toxicity"] == rows["op4_quality"] == rows["op6_ngram_join"] == rows["op8_pieces"]


def test_vectors_in_many_runs_equal_brute_force(spark, monkeypatch):
    """Vectors are broadcast in runs of a few blocks and shuffled once; copies of one vector fill whole batches."""
    monkeypatch.setattr(embedding_join, "CHUNK_BYTES", 64 * 4 * 6 * 3)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 6))
    v = [np.float32(base[rng.integers(30)] + rng.normal(size=6) * rng.choice([0.02, 0.1, 0.3])) for _ in range(900)] + [np.float32(base[0])] * 300
    label = [i % 2 for i in range(len(v))]
    table = spark.createDataFrame([(i, [float(c) for c in x], label[i]) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int").repartition(7)
    blocks = []
    found = embedding_join._found
    monkeypatch.setattr(embedding_join, "_found", lambda b, *rest: blocks.append(b) or found(b, *rest))
    got = {r.vec_id: r for r in embedding_join.near_vectors(table).collect()}
    u = np.array(v, np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(close, False)
    root = roots(len(v), zip(*np.nonzero(close)))
    assert blocks[0].count() > 12 and blocks[0].selectExpr("sum(size(ids))", "sum(aggregate(copies, 0L, (a, c) -> a + c))").first() == (902, 1200)
    assert [(got[i].n_links, got[i].component_id) for i in range(len(v))] == [(int(close[i].sum()), root[i]) for i in range(len(v))]
