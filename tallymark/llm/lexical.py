"""Ranked lexical search with integer scores (operator 11).

The scores of all items in all documents are a product of sparse matrices: how often an item holds a term,
times the impact of the term in a document, all in 64-bit integers. It is worked out block by block. Documents
are read once for their postings, the terms of the items that they hold, which are written as a table. A block of
documents turns its postings into a matrix by terms, each row of items is the sum of those rows of it that
the item names (row merging after Gustavson, into one dense line of the block), and only the best k of each line
leave the block. Best of blocks are merged inside a task, and those of tasks in a second step.

The vocabulary that goes to all tasks is that of one block of items, ``ITEM_BYTES`` of their text at most
(one item may be larger); more items are more blocks, each with its own postings. Texts are worked on in slices of
``SLICE`` bytes that end between terms.

Defined results: a null text has no term and is no document of the collection, nor is one without terms. Each row is a document of its own, repeated
rows too. Rows of items that share an id are one item with the terms of all, each once unless ``multiplicity`` is asked for; null is an id as well. Equal scores
go by ascending doc_id, null last. Items without terms, and items of which no document scores above 0, have no rows. Empty tables give an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.store import settle, temporary

ITEM_BYTES = 16 << 20
SLICE = 1 << 20
BLOCK_DOCS = 4096
#: Postings of a block, at most, unless one document has more.
BLOCK_POSTINGS = 1 << 20
#: Bytes that are no part of a term, ASCII but for digits and letters, become spaces; A-Z become small.
_APART = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    start = 0
    while start < len(text):
        apart = _APART.search(text, start + SLICE)
        end = apart.end() if apart else len(text)
        yield text[start:end].translate(_FOLD).split()
        start = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length_cost: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """int64 impact of each posting."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * length_cost))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): of each document with a term its length, and the terms of the vocabulary that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n bigint, terms array<int>, tfs array<int>").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, sizes, found, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32), [], []
            for i, text in enumerate(batch.column(1)):
                own: Counter = Counter()
                for words in terms(memoryview(text.as_buffer()).tobytes()):
                    lengths[i] += len(words)
                    own.update(map(known.get, words))
                own.pop(None, None)
                sizes[i] = len(own)
                found.append(np.fromiter(own.keys(), np.int32, len(own)))
                counts.append(np.fromiter(own.values(), np.int64, len(own)).clip(max=2**31 - 1).astype(np.int32))
            keep = lengths > 0
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate([*part, np.zeros(0, np.int32)])) for part in (found, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(keep))

    return rows.mapInArrow(work, schema)


def _merged(best: tuple, ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    """The best k of what there is and what comes: largest score, then smallest id, null last."""
    ids, null, scores = (np.concatenate(pair) for pair in zip(best, (ids, null, scores), strict=True)) if best else (ids, null, scores)
    if len(scores) > k:
        order = np.lexsort((ids, null, -scores))[:k]
        ids, null, scores = ids[order], null[order], scores[order]
    return ids, null, scores


def product(held: DataFrame, rows_of: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k documents of each item and task, from postings.

    ``rows_of`` has the terms of each item and how often each counts.
    """
    shared = held.sparkSession.sparkContext.broadcast((rows_of, weights))
    schema = T.StructType([T.StructField("item", T.IntegerType()), held.schema["doc_id"], T.StructField("score", T.LongType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, start = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:
                room = (ends[start - 1] if start else 0) + BLOCK_POSTINGS
                stop = min(max(start + 1, int(np.searchsorted(ends, room, "right"))), start + BLOCK_DOCS, batch.num_rows)
                yield batch.slice(start, stop - start)
                start = stop

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight_of = shared.value
        best: list[tuple] = [()] * len(items)
        kind = None
        for block in blocks(batches):
            kind, size = block.schema.field(0).type, block.num_rows
            null = block.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = block.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            cost = 10 + (90 * block.column(1).to_numpy() * n_docs) // n_terms
            doc = np.repeat(np.arange(size), block.column(2).value_lengths().to_numpy(zero_copy_only=False))
            term = block.column(2).flatten().to_numpy().astype(np.int64)
            value = impacts(block.column(3).flatten().to_numpy().astype(np.int64), cost[doc], weight_of[term])
            order = np.argsort(term, kind="stable")  # from rows of documents to rows of terms
            doc, value = doc[order], value[order]
            begins = np.searchsorted(term[order], np.arange(len(weight_of) + 1))
            for i, (own, times) in enumerate(items):
                line = np.zeros(size, np.int64)
                for t, m in zip(own.tolist(), times.tolist(), strict=True):
                    low, high = begins[t], begins[t + 1]
                    if low < high:
                        line[doc[low:high]] += value[low:high] if m == 1 else m * value[low:high]
                floor = best[i][2].min() if best[i] and len(best[i][2]) >= k else 1
                at = np.flatnonzero(line >= max(floor, 1))
                if len(at) > 4 * k:  # ties with the k-th stay
                    at = at[line[at] >= np.partition(line[at], -k)[-k]]
                if len(at):
                    best[i] = _merged(best[i], ids[at], null[at], line[at], k)
        if kind is not None:
            item = np.repeat(np.arange(len(items), dtype=np.int32), [len(b[2]) if b else 0 for b in best])
            some = [b for b in best if b]
            ids, null, scores = (np.concatenate([b[j] for b in some]) if some else np.zeros(0, t) for j, t in enumerate((np.int64, bool, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null).cast(kind), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return held.mapInArrow(work, schema)


def _items(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text, block), rows of one id in one block, and how many blocks there are."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BYTES) * (2 if size > ITEM_BYTES else 1))
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", multiplicity: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for each item, of all documents."""
    told, blocks = _items(items, item_id, item_text)
    with temporary() as keep:
        parts = [settle(_block(docs, told.where(F.col("block") == b), k, id_col, text_col, multiplicity), "lexical-best") for b in range(blocks)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        keep(out, *parts)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, told: DataFrame, k: int, id_col: str, text_col: str, multiplicity: bool) -> DataFrame:
    spark = docs.sparkSession
    own: dict[object, Counter] = {}
    for row in told.select("id", "text").toLocalIterator():
        counts = own.setdefault(row["id"], Counter())
        for words in terms(bytes(row["text"])):
            counts.update(words)
    names, vocabulary = list(own), {}
    number: Callable[[bytes], int] = lambda w: vocabulary.setdefault(w, len(vocabulary))
    rows_of = [(np.array([number(w) for w in own[i]], np.int64), np.array([c if multiplicity else 1 for c in own[i].values()], np.int64)) for i in names]
    schema = T.StructType([T.StructField("item_id", told.schema["id"].dataType), docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"], T.StructField("score", T.LongType())])
    if not vocabulary:
        return spark.createDataFrame([], schema)
    held = settle(postings(docs, vocabulary, id_col, text_col), "lexical-postings")
    total = held.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return spark.createDataFrame([], schema)
    # one row for each term of the vocabulary, which is bounded
    df = np.zeros(len(vocabulary), np.int64)
    for row in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[row["t"]] = row["count"]
    weights = np.array([weight(total["docs"], int(x)) for x in df], np.int64)
    best = product(held, rows_of, weights, total["docs"], total["terms"], k)
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(names)], T.StructType([T.StructField("item", T.IntegerType()), schema["item_id"]]))
    return best.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
