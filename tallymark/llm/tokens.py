"""Token counts from pre-token frequencies (operator 3).

1. Vocabulary: the distinct pre-tokens of all texts with their frequencies. Batches are
   reduced to their distinct pre-tokens before the shuffle.
2. Each distinct pre-token is cut into pieces once, by the tokenizer library's own model, and
   only the number of pieces is kept.
3. Texts are reduced to (document, pre-token, frequency). The most frequent pre-tokens, at most
   ``HEAD`` with ``HEAD_CHARS`` characters, are joined by broadcast; all others, however many,
   by a shuffled join on the pre-token. Sums by document follow. No ids are made for any document.

Pre-tokens are told apart by their signs; hashes only find equal ones faster.

Pre-tokens are split as byte-level BPE splits them (contractions, letters, digits, other
signs, white space), by classes of code points that are read off the tokenizer itself, so that its
Unicode tables decide and not Python's. Special strings inside texts count as one token each.

Defined results: a null text is empty and has 0 tokens and 0 bytes. Repeated rows: a row is
returned for each; the count belongs to the row, not to the id. Extra columns are ignored.
An empty table gives an empty one. Whole texts are counted, of any length.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import codes
from tallymark.llm.store import settle

#: Pre-tokens that are broadcast with their counts, and their characters together, at most.
HEAD, HEAD_CHARS = 65_536, 4_000_000
#: A longer pre-token is never in the head; each place where it stands is that much text.
LONGEST = 4096
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct pre-tokens that a task holds before it hands them on, and characters that it splits at once.
FLUSH, SLICE = 200_000, 1 << 17
#: Endings that split off after a lone apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec["pre_tokenizer"] or {}
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"] or spec["model"]["type"] != "BPE":
        raise ValueError("byte-level BPE without a normalizer or prefix space is asked for")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take their surroundings are not supported")
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return whole, bare, [t["content"] for t in spec["added_tokens"]]


_tables: dict[str, np.ndarray] = {}
UNKNOWN = 9


def classes(path: str, cps: np.ndarray) -> np.ndarray:
    """The class of each code point: what the tokenizer's own splitter joins it with.

    Each sign is probed once a process: a letter goes with "a" before it, a number with "1" after
    it, any other sign with "!", and white space with none of them.
    """
    if path not in _tables:
        _tables[path] = np.full(0x110000, UNKNOWN, np.uint8)
    table = _tables[path]
    kind = table[cps]
    if not (kind == UNKNOWN).any():
        return kind
    new = np.unique(cps[kind == UNKNOWN])
    text = "".join(f"\na{chr(c)}1\n!{chr(c)}!" for c in new.tolist())
    cuts = np.zeros(len(text) + 1, bool)
    for _, (start, end) in _library(path)[0].pre_tokenizer.pre_tokenize_str(text):
        cuts[start] = cuts[end] = True
    at = np.arange(len(new)) * 8
    other = np.where(~cuts[at + 6], OTHER, SPACE)
    table[new] = np.where(~cuts[at + 2], LETTER, np.where(~cuts[at + 3], NUMBER, other))
    table[0x20] = SPACE  # it joins what follows, a number in the probe too
    return table[cps]


def pretoken_spans(cps: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens; every code point is in exactly one."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last sign of white space before other signs is cut off; a plain space joins what follows
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    cut |= last
    joins = np.flatnonzero(last & (cps == 32))
    cut[joins + 1] = False
    # a lone apostrophe that no space precedes takes its ending with it
    lone = np.flatnonzero(cps[:-1] == 0x27)
    lone = lone[cut[lone] & (kind[lone] == OTHER) & (kind[lone + 1] == LETTER) & ~first[lone + 1]]
    if len(lone):
        ends = np.append(cps, np.zeros(2, np.uint32))
        own = codes.owner(offsets, lone)
        for ending in ENDINGS:
            fits = np.ones(len(lone), bool)
            for j, sign in enumerate(ending, 1):
                fits &= (ends[lone + j] == ord(sign)) & (lone + j < offsets[own + 1])
            hit = lone[fits]
            cut[hit + 1] = False
            after = hit + len(ending) + 1
            cut[after[after < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


def _parts(texts: list[str | None], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts without special strings, the row each part is of, and how many special strings a row has."""
    found = np.zeros(len(texts), np.int64)
    if not any(t and s in t for t in texts for s in special):
        return [t or "" for t in texts], np.arange(len(texts)), found
    parts, rows = [], []
    for i, text in enumerate(texts):
        pieces = [text or ""]
        for s in special:
            pieces = [y for x in pieces for y in x.split(s)]
        found[i] = len(pieces) - 1
        parts += pieces
        rows += [i] * len(pieces)
    return parts, np.array(rows), found


def _reduced(texts: list[str | None], path: str):
    """(pre-tokens, row, index into them, frequency, special strings of each row) of a batch."""
    _, _, special = _library(path)
    parts, rows, found = _parts(texts, special)
    cps, offsets = codes.points(parts)
    starts, ends = pretoken_spans(cps, offsets, classes(path, cps))
    at, which, _ = codes.distinct_runs(cps, starts, ends)
    joined = "".join(parts)
    words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    row = rows[codes.owner(offsets, starts)] if len(starts) else np.zeros(0, np.int64)
    pairs, counts = np.unique(row.astype(np.int64) * max(1, len(words)) + which, return_counts=True)
    return words, pairs // max(1, len(words)), pairs % max(1, len(words)), counts, found


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, freq, n_pieces) of all texts."""

    def distinct(batches):
        def table(counts: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["pretoken", "freq"])

        seen: dict[str, int] = {}
        for batch in batches:
            for part in codes.slices(batch, text_col, SLICE):
                words, _, which, counts, _ = _reduced(part.column(0).to_pylist(), path)
                total = np.bincount(which, counts, len(words)).astype(np.int64)
                for w, n in zip(words, total.tolist(), strict=True):
                    seen[w] = seen.get(w, 0) + n
                if len(seen) > FLUSH:
                    yield table(seen)
                    seen = {}
        if seen:
            yield table(seen)

    def counted(batches):
        _, bare, _ = _library(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            n = []
            for i in range(0, len(words), 1000):
                n += [len(e.ids) for e in bare.encode_batch(words[i : i + 1000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["pretoken", "freq", "n_pieces"])

    words = docs.select(text_col).mapInArrow(distinct, "pretoken string, freq long")
    words = words.groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return settle(words.mapInArrow(counted, "pretoken string, freq long, n_pieces long"), "pretokens")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocab = vocabulary(rows, path)
    short = vocab.where(F.length("pretoken") <= LONGEST)
    # how many pre-tokens there are of each order of frequency: some hundred rows; then those of
    # the highest orders that are within the bounds together, from wherever they are
    order = F.floor(F.log2(F.col("freq")) * 16).cast("int")
    short, room, chars, cut = short.select("pretoken", "n_pieces", order.alias("order")), head, HEAD_CHARS, None
    found = short.groupBy("order").agg(F.count("*").alias("n"), F.sum(F.length("pretoken")).alias("chars"))
    for row in sorted(found.collect(), key=lambda r: -r["order"]):
        room, chars = room - row["n"], chars - row["chars"]
        if room < 0 or chars < 0:
            break
        cut = row["order"]
    known = {} if cut is None else {r["pretoken"]: r["n_pieces"] for r in short.where(F.col("order") >= cut).select("pretoken", "n_pieces").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def frequencies(batches):
        """A row for each text: what the head gives, and its rare pre-tokens with frequencies."""
        from pyspark import TaskContext

        pieces, at = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in codes.slices(batch, "text", SLICE):
                texts = part.column(1).to_pylist()
                words, row, which, counts, found = _reduced(texts, path)
                own = np.fromiter((pieces.get(w, -1) for w in words), np.int64, len(words))[which]
                sums = np.bincount(row, np.where(own >= 0, own * counts, 0), len(texts)).astype(np.int64) + found
                sizes = np.fromiter((len((t or "").encode()) for t in texts), np.int64, len(texts))
                rare = own < 0  # pairs are sorted by row
                ends = np.append(0, np.cumsum(np.bincount(row[rare], minlength=len(texts)))).astype(np.int32)
                tail = pa.array([words[i] for i in which[rare].tolist()], pa.string())
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (tail, pa.array(counts[rare].astype(np.int64)))]
                rows_at = pa.array(np.arange(at, at + len(texts)))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([rows_at, part.column(0), pa.array(sizes), pa.array(sums), *lists], ["row", "doc_id", "n_bytes", "head_tokens", "rare", "freqs"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    shape = f"row long, doc_id {id_type}, n_bytes long, head_tokens long, rare array<string>, freqs array<long>"
    reduced = settle(rows.mapInArrow(frequencies, shape), "token-freqs")
    tail = reduced.select("row", F.explode(F.arrays_zip("rare", "freqs")).alias("x"))
    tail = tail.select("row", F.col("x.rare").alias("pretoken"), F.col("x.freqs").alias("n"))
    tail = tail.join(vocab.select("pretoken", "n_pieces"), "pretoken")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("tail_tokens"))
    out = reduced.select("row", "doc_id", "n_bytes", "head_tokens").join(tail, "row", "left")
    n = (F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))).cast("long")
    return out.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
