"""SentencePiece encoding and decoding as a relational lattice.

Texts are normalised (a leading space, spaces written as U+2581) and split into words, a run of spaces with what follows it; words
are cut where no piece can cross, as between signs that no longer piece holds.  The parts are encoded on their own and each distinct one once: its
substrings of bounded length are exploded and equi-joined to the piece table, the hits are grouped by word as the
edges of a lattice, and a higher-order ``aggregate`` folds Viterbi over them: the segmentation with the
greatest sum of piece scores; of equal sums, the one whose last piece is longer.  Characters without a piece become
byte pieces.  The most frequent parts, at most ``MOST_WORDS`` of at most 64 characters, are broadcast and looked up where the texts
are read; the parts of a text that are not among them are joined to the encoded ones and brought to the text.

The sums are those of a unigram model over the scores in the piece table.  For a table of a BPE model, whose
scores are merge ranks, that is not the order of merges, so ids can differ from those of a BPE encoder;
decoding gives the text back in both cases, but for U+2581 itself: encoding writes spaces as that sign, so a text
that holds it comes back with a space in its place.

Defined results: null text gives null ids, an empty text no ids; repeated rows are encoded alike; an empty table
gives an empty result; further columns are kept (columns named ``ids`` are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import new_folder, private, settings, table

SPACE = "▁"
#: The broadcast table has at most so many words, of at most so many characters.
MOST_WORDS, _SHORT_WORD = 500_000, 64
#: Words counted at once in a task before they are handed on.
_BATCH_WORDS = 500_000
#: Bytes of texts whose words are split and looked up at once in a task, words that are cut at once and words whose ids are gathered at once.
_SLICE_BYTES, _CUT_WORDS, _GATHER_WORDS = 8_000_000, 50_000, 500_000
#: Documents for each task that makes lattices, and the words whose edges a task groups by hash.
_TASK_DOCS, _HASHED_WORDS = 1_000, 20_000
#: Batches of long texts take much memory outside the heap.
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
# Bits and odd factors of the hashes of neighbouring characters.
_HASH_BITS = 22
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_UNKNOWN_PENALTY = 10.0
_LOWEST = -1e8  # pieces scored below are never the better choice


def piece_table(spark: SparkSession, model_file: str) -> tuple[DataFrame, int, int, float]:
    """``piece, piece_id, score`` of the normal pieces, their greatest length, the id of byte 0 and the score of an unknown character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = range(model.get_piece_size())
    rows = [
        (model.id_to_piece(i), i, float(model.get_score(i))) for i in every
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    lowest = min((s for _, _, s in rows if s > _LOWEST), default=0.0)
    found = spark.createDataFrame(rows, "piece string, piece_id int, score double")
    return found, max((len(p) for p, _, _ in rows), default=1), model.piece_to_id("<0x00>"), lowest - _UNKNOWN_PENALTY


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, each a run of spaces with what follows it; the first space of each, which all have, is left out."""
    texts = pc.replace_substring(texts, SPACE, " ")
    plain = pc.split_pattern(texts, " ")
    several = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.equal(pc.binary_length(texts), 0))
    at = np.flatnonzero(several.fill_null(False).to_numpy(zero_copy_only=False))
    if not len(at):
        return plain
    runs = [[w[1:] for w in re.findall(" +[^ ]*", " " + t)] if t else [] for t in texts.take(pa.array(at)).to_pylist()]
    order = np.arange(len(texts))
    order[at] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([plain, pa.array(runs, plain.type)]).take(pa.array(order))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about ``_SLICE_BYTES`` together, at least one."""
    if not len(texts):
        yield texts
    upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _SLICE_BYTES, "right")))
        yield texts.slice(start, end - start)
        start = end


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """A number below ``2 ** _HASH_BITS`` for each ``n`` neighbouring characters."""
    mixed = codes[:len(codes) - n + 1] * _FACTORS[0]
    for k in range(1, n):
        mixed = mixed ^ codes[k:len(codes) - n + 1 + k] * _FACTORS[k]
    return mixed >> np.uint32(32 - _HASH_BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _cutter(pieces: list[str]) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]]:
    """A function from words to their parts, all in a row, and the number of parts of each word.

    A piece that crosses a place in a word is the two characters there, or it holds them and the one before or behind.
    Such pairs and threes are marked by their hashes; where neither is marked no piece crosses and the word is cut.  Two hashes that are
    equal by chance only leave a word uncut there.
    """
    two, three = (np.zeros(1 << _HASH_BITS, bool) for _ in range(2))
    pairs, longer = ("".join(p for p in pieces if test(len(p))) for test in ((2).__eq__, (2).__lt__))
    if pairs:
        two[_hashed(_codes(pairs), 2)[::2]] = True
    if longer:
        sizes = np.array([len(p) for p in pieces if len(p) > 2])
        inside = np.ones(len(longer), bool)
        ends = np.cumsum(sizes)
        inside[ends - 1] = inside[ends - 2] = False
        three[_hashed(_codes(longer), 3)[inside[:len(longer) - 2]]] = True

    def cut(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        done = [some(words.slice(i, _CUT_WORDS)) for i in range(0, len(words), _CUT_WORDS)]
        if not done:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        return pa.concat_arrays([parts for parts, _ in done]), np.concatenate([n for _, n in done])

    def some(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n" + SPACE)[0].as_py()
        text = (SPACE + whole).replace(" ", SPACE) + "\n"
        codes = _codes(text)
        between = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64) + 2) - 1
        crossed = np.zeros(len(codes), bool)  # behind each character
        crossed[:-1] = two[_hashed(codes, 2)]
        if len(codes) > 2:
            marked = three[_hashed(codes, 3)]
            crossed[:-2] |= marked
            crossed[1:-1] |= marked
        crossed[between - 1] = crossed[between] = False
        starts = np.concatenate([[0], np.flatnonzero(~crossed) + 1])
        own = np.ones(len(codes), bool)
        own[between] = False
        kept = own[starts[:-1]]
        width = np.ones(len(codes), np.int32)
        for least in (0x80, 0x800, 0x10000):
            width += codes >= least
        offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int32)])[starts].astype(np.int32)
        parts = pa.StringArray.from_buffers(len(kept), pa.py_buffer(offsets), pa.py_buffer(text.encode("utf-8"))).filter(pa.array(kept))
        return parts, np.diff(np.searchsorted(starts[:-1][kept], between), prepend=0)

    return cut


def count_words(texts: DataFrame, pieces: list[str], tasks: int) -> DataFrame:
    """``word, n``: the distinct parts of the words of a column ``text`` and how often they stand; counted per batch before the shuffle to ``tasks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = _cutter(pieces), []

        def total(parts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        def counted(words: pa.Table) -> Iterator[pa.RecordBatch]:
            parts, sizes = cut(words["word"].combine_chunks())
            n = np.repeat(words["n"].to_numpy(), sizes)
            return iter(total([pa.table({"word": parts, "n": n})]).to_batches())

        for batch in batches:
            for texts in _slices(batch.column(0)):
                found = _words(texts).flatten().value_counts()
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                if sum(t.num_rows for t in held) > _BATCH_WORDS:
                    held = [total(held)]
                    if held[0].num_rows > _BATCH_WORDS // 2:
                        yield from counted(held.pop())
        if held:
            yield from counted(total(held))
        held.clear()
        pa.default_memory_pool().release_unused()

    return texts.filter("text is not null").mapInArrow(run, "word string, n bigint").repartition(tasks, "word").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, pieces: DataFrame, longest: int, byte_zero: int, unknown: float) -> DataFrame:
    """``word, n, ids`` for distinct rows ``word, n``."""
    words = words if "n" in words.columns else words.withColumn("n", F.lit(1).cast("bigint"))
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    ends = starts.select(
        "word", "n", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.length("word"), F.col("start") + longest))).alias("end"))
    parts = ends.withColumn("piece", F.expr("substring(word, start + 1, end - start)"))
    # The piece table is bounded by the vocabulary.
    hits = parts.join(F.broadcast(pieces), "piece", "left").filter("piece_id is not null or end = start + 1")
    edge = F.struct("end", "start", F.coalesce("piece_id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
    lattice = hits.groupBy("word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges"))

    def better(best: Column, e: Column) -> Column:
        sum_ = F.get(best, e["start"])["sum"] + e["score"]
        step = F.struct(sum_.alias("sum"), e["start"].alias("start"), e["id"].alias("id"))
        last = F.size(best) - 1
        return (
            F.when(last < e["end"], F.concat(best, F.array(step)))
            .when(sum_ > F.get(best, last)["sum"], F.concat(F.slice(best, F.lit(1), last), F.array(step)))
            .otherwise(best))

    zero = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("id")))
    best = lattice.select("word", "n", F.aggregate("edges", zero, better).alias("best"))

    def back(path: Column, k: Column) -> Column:
        node = F.get(F.col("best"), k)
        hexed = F.hex(F.encode(F.substr(F.col("word"), k, F.lit(1)), "utf-8"))
        as_bytes = F.transform(
            F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")),
            lambda i: (F.conv(F.substr(hexed, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + byte_zero))
        ids = F.when(node["id"] >= 0, F.array(node["id"])).otherwise(as_bytes)
        taken = F.struct(node["start"].alias("at"), F.concat(ids, path["ids"]).alias("ids"))
        return F.when(path["at"] == k, taken).otherwise(path)

    length = F.length("word")
    start = F.struct(length.alias("at"), F.array().cast("array<int>").alias("ids"))
    path = F.aggregate(F.sequence(length, F.lit(1), F.lit(-1)), start, back)
    return best.select("word", "n", path["ids"].alias("ids"))


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The short words of at least a certain count, which at most ``most`` words have."""
    short = words.filter(F.length("word") <= _SHORT_WORD)
    level = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    return short.filter(level >= least) if least is not None else short.limit(0)


def _packed(few: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, few.schema) as out:
        out.write_table(few)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words, the starts of their ids (one more than words) and the ids, without an object for each."""
    few = pa.ipc.open_stream(held).read_all().combine_chunks()
    if not few.num_rows:
        return pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32)
    ids = few["ids"].chunk(0)
    return few["word"].chunk(0), ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)]


class _Encoded:
    """The words of a slice of texts, looked up by their parts in a table (``_unpacked``) and among ``others``."""

    def __init__(self, texts: pa.Array, cut: Callable, have: tuple[pa.Array, np.ndarray, np.ndarray]):
        lists = _words(texts)
        self._texts, self._sizes = texts, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = lists.flatten().dictionary_encode()
        self._at = found.indices.to_numpy()
        parts, self._n = cut(found.dictionary)
        parts = parts.dictionary_encode()
        self._code, self._parts, self._have = parts.indices.to_numpy(), parts.dictionary, have
        place = pc.index_in(self._parts, value_set=have[0]).fill_null(-1)
        self._place = place.to_numpy(zero_copy_only=False).astype(np.int64)

    def rare(self) -> pa.ListArray:
        """For each text its distinct parts that the table lacks."""
        lacked = self._place < 0
        first = np.cumsum(self._n) - self._n
        of_word = np.repeat(np.arange(len(self._n)), self._n)
        words = np.zeros(len(self._n), bool)
        words[of_word[lacked[self._code]]] = True
        at = np.flatnonzero(words[self._at])
        text, word = np.repeat(np.arange(len(self._texts)), self._sizes)[at], self._at[at]
        pair = np.repeat(text, self._n[word]) * len(lacked) + _gathered(self._code, first[word], self._n[word])
        pair = np.unique(pair[lacked[pair % len(lacked)]]) if len(pair) else np.zeros(0, np.int64)
        text, part = np.divmod(pair, max(1, len(lacked)))
        offsets = np.searchsorted(text, np.arange(len(self._texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), self._parts.take(pa.array(part)))

    def ids(self, others: pa.Array) -> pa.ListArray:
        """The ids of each text; ``others`` are structs ``word, ids`` of what the table lacks."""
        _, offsets, ids = self._have
        lacked = np.flatnonzero(self._place < 0)
        place, starts = self._place.copy(), offsets
        if len(lacked):
            more = others.field("ids")
            lists = more.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([offsets, offsets[-1] + np.cumsum(lists)])
            ids = np.concatenate([ids[:offsets[-1]], more.flatten().to_numpy()])
            given = pc.index_in(self._parts.take(pa.array(lacked)), value_set=others.field("word"))
            place[lacked] = given.to_numpy() + len(offsets) - 1
        sizes = starts[place + 1] - starts[place]
        flat = _gathered(ids, starts[place][self._code], sizes[self._code])
        ends = np.concatenate([[0], np.cumsum(sizes[self._code])])
        last = np.cumsum(self._n)
        word_start, word_size = ends[last - self._n], ends[last] - ends[last - self._n]
        chunks = [self._at[i:i + _GATHER_WORDS] for i in range(0, len(self._at), _GATHER_WORDS)]
        out = [_gathered(flat, word_start[at], word_size[at]).astype(np.int32) for at in chunks]
        upto = np.concatenate([[0], np.cumsum(word_size[self._at])])[np.concatenate([[0], np.cumsum(self._sizes)])]
        lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(np.concatenate([*out, np.zeros(0, np.int32)]), pa.int32()))
        return pc.if_else(self._texts.is_null(), pa.scalar(None, lists.type), lists) if self._texts.null_count else lists


def encode(docs: DataFrame, model_file: str, text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the text; ``most_words`` bounds the broadcast table of frequent words."""
    spark = docs.sparkSession
    pieces, longest, byte_zero, unknown = piece_table(spark, model_file)
    spelled = [r["piece"] for r in pieces.select("piece").collect()]  # bounded by the vocabulary
    text = F.col(text_col).cast("string")
    words_path = new_folder(spark, "encoded-words")
    # Dealt out by word once, for the counts and for the lattice, which is grouped by word where its edges are made, many times as many as words.
    counted = count_words(docs.select(text.alias("text")), spelled, 1 + docs.count() // _TASK_DOCS)
    # A task's words fit in memory, so their edges are grouped by hash and need no sorting.
    with settings(spark, _SMALL_BATCHES | {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(_HASHED_WORDS)}):
        encode_words(counted, pieces, longest, byte_zero, unknown).write.parquet(words_path)
    words = spark.read.parquet(words_path)

    few = _frequent(words, most_words).select("word", "ids").toArrow().combine_chunks()
    known = spark.sparkContext.broadcast(_packed(few))

    @F.arrow_udf("array<string>")
    def rare_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut, have = _cutter(spelled), _unpacked(known.value)
        for texts in batches:
            yield pa.concat_arrays([_Encoded(part, cut, have).rare() for part in _slices(texts)])
            pa.default_memory_pool().release_unused()

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cut, have = _cutter(spelled), _unpacked(known.value)
        for texts, others in batches:
            done, start = [], 0
            for part in _slices(texts):
                done.append(_Encoded(part, cut, have).ids(others.slice(start, len(part)).flatten()))
                start += len(part)
            yield pa.concat_arrays(done)
            pa.default_memory_pool().release_unused()

    rare = rare_of.asNondeterministic()  # made once for each text, not again to see whether it has rows
    # Equal texts have equal ids: texts are known by their digest.
    key, others = private(docs, "_text_key"), private(docs, "_rare_words")
    # The digest is made before the texts' rare words become rows, not for each of them.
    places = docs.filter(text.isNotNull()).select(F.unhex(F.md5(text)).alias(key), rare(text).alias("words")).select(key, F.explode("words").alias("word"))
    found = places.join(words.select("word", "ids"), "word").groupBy(key).agg(F.collect_set(F.struct("word", "ids")).alias(others))
    keyed = docs.drop("ids").withColumn(key, F.unhex(F.md5(text)))
    return keyed.join(found, key, "left").withColumn("ids", ids_of(text, F.col(others))).drop(key, others)


def _decoder(model_file: str) -> Callable[[Column], Column]:
    """Ids to text within a row: nothing is shuffled, however long the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    raw = []  # by id; bounded by the vocabulary
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[1:-1], 16)]))
        else:
            raw.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode("utf-8"))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        def one(row) -> str | None:  # without the leading space
            return None if row is None else b"".join(map(raw.__getitem__, row.tolist()))[1:].decode("utf-8", "replace")

        return pd.Series([one(row) for row in ids], dtype=object)

    return text_of


def decode(rows: DataFrame, model_file: str, key: str, ids_col: str = "ids") -> DataFrame:
    """``key, text`` of rows with piece ids."""
    return rows.select(key, _decoder(model_file)(F.col(ids_col)).alias("text"))


def public_model() -> str:
    import public_tokenizers as files

    return files.path("piece_bpe_32k.model")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids_sum, ids_sha256, decoded_sha256, round_trip`` per document (null text: nulls).

    The last two are the digest of the text decoded from the ids and whether it is the document's text.
    """
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_model())
    docs = docs.withColumn("decoded", _decoder(public_model())(F.col("ids")))
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x)
    digests = docs.select(
        "doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("bigint").alias("n_pieces"), total.alias("ids_sum"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
    path = new_folder(spark, "pieces")
    with settings(spark, _SMALL_BATCHES):
        digests.write.parquet(path)
    return spark.read.parquet(path)
