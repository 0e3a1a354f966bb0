"""Evaluation texts leaking into training text: word n-grams of the items in a broadcast hash set."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.texthash import U, mix
from chronoloom.session import cut

WORDS = 12
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits after NFKC and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class NGrams:
    """The distinct n-grams of a block of items, by length, as sorted hashes over a bitmap.

    Its size follows the words of the block, which :func:`item_blocks` bounds.
    """

    def __init__(self, items: list[tuple[int, list[str]]], n: int) -> None:
        self.ids: dict[str, int] = {}
        grams: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words]
            size = min(n, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                grams[size][tuple(w[k : k + size])].add(item)
        self.sizes = {}
        for size, found in grams.items():
            keys = list(found)
            h = self.hashes(np.array(keys, np.int64).reshape(-1), size)[::size] if keys else np.zeros(0, U)
            bits = np.zeros(1 << 20, bool)
            bits[(h & U((1 << 20) - 1)).astype(np.int64)] = True
            table: dict[int, list[tuple[tuple[int, ...], list[int]]]] = defaultdict(list)
            for x, key in zip(h.tolist(), keys, strict=True):
                table[x].append((key, sorted(found[key])))
            self.sizes[size] = (bits, dict(table))

    @staticmethod
    def hashes(ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of the window of *size* ids at every place."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, U)
        v = mix(ids.astype(U) + U(0x1234567))
        out = np.zeros(n, U)
        for k in range(size):
            out = out * U(0x9E3779B97F4A7C15) + v[k : k + n]
        return mix(out)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(place, size, items) of every window of the items found in *ids*; 0 stands for a foreign word."""
        out = []
        foreign = np.r_[0, np.cumsum(ids == 0)]
        for size, (bits, table) in self.sizes.items():
            h = self.hashes(ids, size)
            near = np.flatnonzero(bits[(h & U((1 << 20) - 1)).astype(np.int64)] & (foreign[size:] == foreign[: len(h)])) if len(h) else []
            for p in near:
                for key, items in table.get(int(h[p]), ()):  # verified word by word
                    if tuple(ids[p : p + size].tolist()) == key:
                        out.append((int(p), size, items))
        return out


def item_blocks(items: DataFrame, item: str, text: str, most: int) -> list[DataFrame]:
    """Items in blocks of at most *most* characters of text each (an item beyond that alone).

    The number of blocks follows from one sum; a bounded table is one block. Items are spread over
    more blocks by running characters in id order within a hash bucket, so no sort meets in one task.
    """
    sized = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= most:
        return [sized]
    buckets = -(-2 * total // most)
    w = Window.partitionBy("_b").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(buckets))).withColumn("_c", F.floor(F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) / most))
    pairs = placed.select("_b", "_c").distinct().collect()
    return [placed.where((F.col("_b") == r._b) & (F.col("_c") == r._c)).select("item_id", "text") for r in sorted(pairs)]


def leaked_passages(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WORDS, block_chars: int = 8 * BLOCK_WORDS) -> DataFrame:
    """Leaked windows: doc_id, item_id, first_word, n_words (places count words of the document).

    Method: the items' n-grams of normalised words (all words of a shorter item) form a hash set that
    is broadcast; the token windows of each document are scanned against it in whole arrays, and hits
    are verified word by word. The set is broadcast only up to *block_chars* characters of items;
    more are taken block by block, each over all documents: its hits are written and its set is
    destroyed before the next one is collected, so the driver holds one block whatever their number.
    The documents are read once a block, never shuffled, and no task holds more than a batch.

    Defined cases: null and empty texts and items without words leak nothing; repeated documents and
    items are reported each; an item of under *n* words must stand as a whole; words are Unicode.
    """
    source = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    spark = documents.sparkSession

    def scan(block: DataFrame) -> tuple[DataFrame, Broadcast]:
        grams = spark.sparkContext.broadcast(NGrams([(r.item_id, words_of(r.text)) for r in block.collect()], n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = grams.value
            for b in batches:
                out = _scan_batch(g, b.column(0).to_pylist(), b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "first_word", "n_words"])

        return source.mapInArrow(run, "doc_id BIGINT, item_id BIGINT, first_word INT, n_words INT"), grams

    blocks = item_blocks(items, item, item_text, block_chars)
    if len(blocks) == 1:
        return scan(blocks[0])[0]
    parts = []
    for block in blocks:
        found, grams = scan(block)
        parts.append(cut(found, "leaks"))
        grams.destroy()
    return reduce(DataFrame.unionByName, parts)


def _scan_batch(g: NGrams, docs: list[int], texts: list[str], most: int = 200_000) -> list[tuple[int, int, int, int]]:
    out, ids, starts, held = [], [], [], []
    get = g.ids.get
    least = min(g.sizes, default=1)

    def flush() -> None:
        place = np.array(starts)
        for p, size, items in g.hits(np.array(ids, np.int64)):
            k = int(np.searchsorted(place, p, "right")) - 1
            out.extend((held[k], i, p - starts[k], size) for i in items)
        ids.clear(), starts.clear(), held.clear()

    for d, t in zip(docs, texts, strict=True):
        w = [get(x, 0) for x in words_of(t)]
        if len(w) < least:
            continue
        starts.append(len(ids))
        held.append(d)
        ids.extend(w)
        ids.append(0)  # no window crosses texts
        if len(ids) > most:
            flush()
    if held:
        flush()
    return out


def leaks(passages: DataFrame) -> DataFrame:
    """Documents with the items they leak."""
    return passages.select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, passages: DataFrame, doc: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """The documents with leaked spans removed, or, with *whole*, without the leaking documents.

    A span is removed with the white-space delimited pieces its words belong to, white space kept.
    Documents without leaks, null texts included, stay as they are, and so do all other columns.
    """
    if whole:
        return documents.join(passages.select(F.col("doc_id").alias(doc)).distinct(), doc, "left_anti")
    spans = passages.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("first_word", "n_words")).alias("_spans"))

    @F.pandas_udf("string")
    def removed(texts, spans):  # noqa: ANN001, ANN202
        return texts.combine(spans, _remove)

    return documents.join(spans, doc, "left").withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(removed(F.col(text), F.col("_spans")))).drop("_spans")


def _remove(text: str | None, spans: list | None) -> str | None:
    if text is None or spans is None:
        return text
    bad = {k for s in spans for k in range(s["first_word"], s["first_word"] + s["n_words"])}
    out, at = [], 0
    for piece in re.split(r"(\s+)", text):
        n = len(words_of(piece))
        if not bad.intersection(range(at, at + n)):
            out.append(piece)
        at += n
    return "".join(out)
