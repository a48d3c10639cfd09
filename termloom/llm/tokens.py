"""Encoding of a corpus with a public tokenizer through a table of its distinct words."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.session import written

#: Fixed value: the byte-level split into words, with Unicode classes. Every character of a text belongs to one word.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words in the part of the word table that every task holds, and its most bytes (words and ids).
HEAD_WORDS, HEAD_BYTES = 32_768, 16 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The text of a tokenizer file: a path, or the name of a file of the installed public tokenizers."""
    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as f:
        return f.read()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words_by_tokenizer(texts: pd.Series) -> pd.Series:
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return texts.map(lambda t: None if t is None else [t[a:b] for _, (a, b) in split(t)])


def words_of(text: Column) -> Column:
    """The words of a text in order: null for null, empty for empty; joined they give the text.

    The split runs in the JVM. Only a text with a character that the JVM's older Unicode tables do not know, and so cannot
    class, is split by the tokenizer's own rule in Python.
    """
    odd = text.rlike(r"\p{Cn}")
    return F.coalesce(_words_by_tokenizer(F.when(odd, text)), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))


def distinct_words(df: DataFrame, text: str, vocab: str) -> DataFrame:
    """``(word, n, ids)``: each distinct word of the corpus once, how often it stands there, and its ids."""
    counted = df.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    model = df.sparkSession.sparkContext.broadcast(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.value)
        t.encode_special_tokens = True
        for batch in batches:
            ids = [e.ids for e in t.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return counted.mapInArrow(encode, "word string, n bigint, ids array<int>")


def _joined(pool: pa.Array, index: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat ids of lists of words given as indices into ``pool``."""
    taken = pool.take(pa.array(index))
    inner = taken.offsets.to_numpy()
    return (inner[off] - inner[0]).astype(np.int32), taken.flatten()


def head_of(table: DataFrame) -> DataFrame:
    """The most frequent words that fit into ``HEAD_WORDS`` and ``HEAD_BYTES``: those standing at least so many times.

    The least count is found from the number and size of the words of each power of two, then of each count within one power:
    at most some thousand rows reach the driver, and tasks send nothing but words of the head. What room is left goes to words
    of the next count, chosen by their hash.
    """
    power = F.floor(F.log2("n")).cast("int")
    size = F.octet_length("word") + 4 * F.size("ids") + 16
    room, space, least = HEAD_WORDS, HEAD_BYTES, 1 << 62

    def taken(steps: DataFrame) -> Row | None:
        """Takes steps while they fit; returns the first that does not."""
        nonlocal room, space, least
        for step in steps.collect():
            if step["words"] > room or step["bytes"] > space:
                return step
            room, space, least = room - step["words"], space - step["bytes"], step["least"]
        return None

    sums = [F.count(F.lit(1)).alias("words"), F.sum(size).alias("bytes"), F.min("n").alias("least")]
    over = taken(table.groupBy(power.alias("step")).agg(*sums).orderBy(F.desc("step")))
    if over is None or over["step"] > 12:
        return table.where(F.col("n") >= least)
    over = taken(table.where(power == over["step"]).groupBy(F.col("n").alias("step")).agg(*sums).orderBy(F.desc("step")))
    share = 0 if over is None else int(900 * min(room / over["words"], space / over["bytes"]))
    sure = table.where(F.col("n") >= least)
    return sure.unionByName(table.where((F.col("n") == over["step"]) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < share)).limit(room)) if share else sure


def encode_corpus(df: DataFrame, key: str, text: str, vocab: str | None = None) -> DataFrame:
    """``key, ids`` of every row: the ids of ``text``, an empty list for an empty text, null for a null text.

    Words are split in Spark (twice: writing the lists of words costs more CPU and disk than splitting again, see the README);
    each distinct word is encoded once. The most frequent words
    (:func:`head_of`, so of proven size, whatever their length) are looked up where the lists are read; only the other occurrences
    are joined with the word table and put back by position. Rows are told apart by their place, so repeated keys do no harm.
    """
    spark = df.sparkSession
    vocab = vocab or vocabulary()
    table = written(distinct_words(df, text, vocab), "words")
    head = head_of(table).collect()
    shared = spark.sparkContext.broadcast(([r["word"] for r in head], [r["ids"] for r in head]))
    key_type = df.schema[key].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value[0], pa.string())
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(1)
            valid = pc.is_valid(lists)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            off = np.concatenate([[0], np.cumsum(sizes)])
            words = lists.flatten()
            code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            rare = code < 0
            rare_off = np.concatenate([[0], np.cumsum(rare)])[off].astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(code))
            others = pa.ListArray.from_arrays(pa.array(rare_off), words.filter(pa.array(rare)).cast(pa.string()))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pc.if_else(valid, codes, pa.scalar(None, codes.type)), others], names=["row", "__key", "codes", "others"])

    split = df.select(F.col(key).alias("__key"), words_of(F.col(text)).alias("words"))
    coded = written(split.mapInArrow(look_up, f"row bigint, __key {key_type}, codes array<int>, others array<string>"), "coded")
    rare = coded.select("row", F.posexplode("others").alias("pos", "word")).join(table.select("word", "ids"), "word")
    back = rare.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda s: s["ids"]).alias("rest"))
    empty = F.array().cast("array<array<int>>")
    whole = coded.where(F.size("others") <= 0).select("__key", "codes", empty.alias("rest"))
    mixed = coded.where(F.size("others") > 0).join(back, "row").select("__key", "codes", "rest")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(shared.value[1], pa.list_(pa.int32()))
        for batch in batches:
            codes, rest = batch.column(1), batch.column(2)
            flat = codes.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(codes), 0).to_numpy().astype(np.int64)
            off = np.concatenate([[0], np.cumsum(sizes)])
            later = rest.flatten()
            later = pa.ListArray.from_arrays(pc.subtract(later.offsets, later.offsets[0]), later.flatten()) if len(later) else pa.array([], ids.type)
            pool = pa.concat_arrays([ids, later.cast(ids.type)])
            missing = flat < 0
            index = np.where(missing, len(ids) + np.cumsum(missing) - 1, flat)
            at, out = _joined(pool, index, off)
            made = pa.ListArray.from_arrays(pa.array(at), out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_valid(codes), made, pa.scalar(None, made.type))], names=[key, "ids"])

    return whole.unionByName(mixed).mapInArrow(assemble, f"{key} {key_type}, ids array<int>")


def pieces(vocab: str | None = None) -> list[bytes]:
    """The bytes of every id of the vocabulary, by id; ids that are not given out have none."""
    model = json.loads(vocab or vocabulary())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    by_id = {i: bytes(byte_of[c] for c in p) for p, i in model["model"]["vocab"].items() if p not in special} | {i: p.encode() for p, i in special.items()}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def decode_corpus(df: DataFrame, key: str, ids: str, vocab: str | None = None) -> DataFrame:
    """``key, text`` of lists of ids, every id joined with its piece; null for null, empty for empty lists.

    The piece table (as many rows as the vocabulary) is held by every task and joined in place by position, whole Arrow arrays
    at a time: no shuffle, and keys may repeat. An id outside the vocabulary, or null, adds nothing; bytes that are no UTF-8
    become replacement characters.
    """
    shared = df.sparkSession.sparkContext.broadcast(pieces(vocab))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*shared.value, b""], pa.large_binary())
        for batch in batches:
            lists = batch.column(1)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.where((flat < 0) | (flat >= len(table)), len(table) - 1, flat)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            off = np.concatenate([[0], np.cumsum(sizes)])
            taken = table.take(pa.array(flat))
            inner = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
            place = np.ascontiguousarray(inner[off] - inner[0])
            data = taken.buffers()[2].slice(int(inner[0])) if len(taken) and taken.buffers()[2] is not None else pa.py_buffer(b"")
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(place), data])
            try:
                made = texts.cast(pa.string())
            except pa.ArrowInvalid:
                made = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_valid(lists), made, pa.scalar(None, pa.string()))], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {key_type}, text string")
