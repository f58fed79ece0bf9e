"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding (operator 2).

The agenda holds the candidate merges, best score first, leftmost on ties. Each candidate,
known by where it starts, meets and ends in its pre-token, is skipped if a keyed hash says so;
with a dropout of 0 the result is the library's own. A skipped candidate stays skipped, but
its symbols can still merge with others, so that segmentations vary and are always made of
merges. The key is the seed, the pre-token, the document (with the number of its copy, if a column
of ``encode`` gives one) and the place: each occurrence is drawn by itself, and reruns agree.
``variants`` above 0 lets occurrences share so many segmentations of a pre-token.

All pre-tokens of a batch are merged together, as rows of a matrix: one round merges the best
candidate of every row. Longer ones go through a heap, one at a time.

White space is kept: a space is U+2581 as in the library, and a U+2581 of the text itself
becomes byte pieces, as does every sign that has no piece. ``decode`` gives back any text.

Defined results: a null or empty text has no pieces and decodes to the empty text. Repeated
rows with one id, and one copy number if there is one, get one segmentation. A null id hashes as 0. Extra columns are carried by
``encode``, and a column of theirs named as one of the results is replaced. An empty table
gives an empty one. A text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm import codes

DROPOUT = 0.1
#: 0: each occurrence has its own segmentation.
VARIANTS = 0
#: Characters that are encoded together.
BATCH_CHARS = 1 << 19
#: Row lengths of the matrices; longer pre-tokens go through the heap.
WIDTHS = (1, 4, 7, 10, 14, 20, 32, 64)
MARK, OWN_MARK = 0x2581, 0x110000
NEVER = np.int32(2**31 - 1)
_ODD = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7]


@dataclass(frozen=True)
class Model:
    sign: np.ndarray  # piece of each code point, -1 if none
    byte: np.ndarray  # piece of each byte
    pairs: np.ndarray  # sorted keys left * size + right
    merged: np.ndarray  # piece that a pair makes
    rank: np.ndarray  # of a piece as the result of a merge; lower merges first
    surface: np.ndarray  # bytes of all pieces, one after the other, spaces for U+2581
    begins: np.ndarray  # where those of a piece begin, and the last end
    size: int


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    if not sp.is_byte(sp.piece_to_id("<0x41>")):
        raise ValueError("a model with byte fallback is asked for")
    plain = {p: i for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    sign = np.full(OWN_MARK + 1, -1, np.int32)
    for p, i in plain.items():
        if len(p) == 1:
            sign[ord(p)] = i
    byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    table = {}
    for p, i in plain.items():
        for k in range(1, len(p)):
            left, right = plain.get(p[:k]), plain.get(p[k:])
            if left is not None and right is not None:
                table[left * n + right] = i
    pairs = np.array(sorted(table), np.int64)
    _, rank = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)
    raw = [b"" if i not in known else p.replace("▁", " ").encode() for known in [set(plain.values())] for i, p in enumerate(names)]
    for b, i in enumerate(byte.tolist()):
        raw[i] = bytes([b])
    begins = np.append(0, np.cumsum([len(x) for x in raw]))
    return Model(sign, byte, pairs, np.array([table[k] for k in pairs.tolist()], np.int32), rank.astype(np.int32), np.frombuffer(b"".join(raw), np.uint8), begins, n)


def _candidates(m: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pieces that pairs of pieces make, -1 if none."""
    keys = left.astype(np.int64) * m.size + right
    at = np.minimum(np.searchsorted(m.pairs, keys), len(m.pairs) - 1)
    return np.where((m.pairs[at] == keys) & (left >= 0) & (right >= 0), m.merged[at], -1)


def _skipped(key, start, mid, end, dropout: float) -> np.ndarray:
    spread = sum(np.asarray(x).astype(np.uint64) * np.uint64(c) for x, c in zip((start, mid, end), _ODD, strict=True))
    return (codes.mixed(key + spread) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def merge_rows(m: Model, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each row of symbols, and which places hold one."""
    n, width = symbols.shape
    ids = symbols.astype(np.int32)
    alive = np.arange(width) < lengths[:, None]
    if width == 1:
        return ids, alive
    step = width + 1
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1)).ravel()
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1)).ravel()
    made = np.full((n, step), -1, np.int32)
    made[:, : width - 1] = _candidates(m, ids[:, :-1], ids[:, 1:])
    at = np.arange(width - 1)
    if dropout > 0:
        gone = _skipped(keys[:, None], at, at + 1, at + 2, dropout)
        made[:, : width - 1][gone] = -1
    rank = np.where(made >= 0, m.rank[made], NEVER)
    made, flat = made.ravel(), np.full(n * step, -1, np.int32)
    flat.reshape(n, step)[:, :width] = ids
    live, row = rank, np.arange(n)
    dead = np.zeros(n * step, bool)

    def renew(base, slot, k, ends):
        """The candidate of a symbol and the one after it, where there are both."""
        fit = np.flatnonzero((slot >= 0) & (ends[0] < ends[1]))
        base, slot, k = base[fit], slot[fit], k[fit]
        mid = after[base + slot]
        piece = _candidates(m, flat[base + slot], flat[base + mid])
        if dropout > 0:
            piece[_skipped(k, slot, mid, after[base + mid], dropout)] = -1
        made[base + slot] = piece
        return fit, slot, np.where(piece >= 0, m.rank[piece], NEVER)

    while len(row):
        best = live.argmin(1)
        here = np.arange(len(row))
        keep = live[here, best] < NEVER
        if not keep.all():
            live, row, best = live[keep], row[keep], best[keep]
            here = np.arange(len(row))
        if not len(row):
            break
        base, k, size = row * step, keys[row], lengths[row]
        right = after[base + best]
        end = after[base + right]
        flat[base + best] = made[base + best]
        dead[base + right] = True
        after[base + best] = end
        inside = end < size
        before[(base + end)[inside]] = best[inside]
        live[here, right] = NEVER
        live[here, best] = NEVER
        fit, slot, new = renew(base, best, k, (end, size))
        live[fit, slot] = new
        prior = before[base + best]
        fit, slot, new = renew(base, prior, k, (best, size))
        live[fit, slot] = new
    return flat.reshape(n, step)[:, :width], alive & ~dead.reshape(n, step)[:, :width]


def merge_one(m: Model, symbols: list[int], key: int, dropout: float) -> list[int]:
    """The same for one pre-token, by an agenda."""
    n = len(symbols)
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    pair = {}
    agenda: list[tuple[int, int, int, int]] = []
    mask = (1 << 64) - 1

    def mixed(x: int) -> int:
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j >= n or ids[i] < 0 or ids[j] < 0:
            return
        k = ids[i] * m.size + ids[j]
        if k not in pair:
            at = int(np.searchsorted(m.pairs, k))
            pair[k] = int(m.merged[at]) if at < len(m.pairs) and m.pairs[at] == k else -1
        if pair[k] >= 0:
            h = mixed((key + i * _ODD[0] + j * _ODD[1] + after[j] * _ODD[2]) & mask)
            if dropout <= 0 or (h >> 11) * 2.0**-53 >= dropout:
                heapq.heappush(agenda, (int(m.rank[pair[k]]), i, j, after[j]))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while agenda:
        _, i, j, end = heapq.heappop(agenda)
        if gone[i] or gone[j] or after[i] != j or after[j] != end:
            continue
        ids[i] = pair[ids[i] * m.size + ids[j]]
        gone[j], after[i] = True, end
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    return [x for x, g in zip(ids, gone, strict=True) if not g]


def encode_batch(texts: list[str | None], path: str, doc_keys: np.ndarray, seed: int = 1, dropout: float = DROPOUT, variants: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """All pieces, and where those of each text begin and the last end."""
    m = model(path)
    raw, offsets = codes.points(texts)
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    signs = raw.copy()
    signs[raw == MARK] = OWN_MARK
    signs[raw == 0x20] = MARK
    signs = np.insert(signs, offsets[:-1][full], MARK)
    bounds = offsets + np.append(0, np.cumsum(offsets[:-1] < offsets[1:]))
    symbols = m.sign[signs]
    cut = np.zeros(len(signs), bool)
    cut[bounds[:-1][full]] = True
    cut[1:] |= (signs[1:] == MARK) & (signs[:-1] != MARK)
    alone = symbols < 0
    cut |= alone
    cut[1:] |= alone[:-1]
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(signs))
    text = codes.owner(bounds, starts)
    place = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[text]
    pick = codes.mixed(doc_keys[text] + (place + 1).astype(np.uint64) * np.uint64(_ODD[1]) + np.uint64(seed))
    if dropout > 0 and not variants:  # each occurrence by itself
        keys, at = codes.run_hashes(signs, starts, ends), np.arange(len(starts))
        which = at
    else:  # once for each kind, or each variant of a kind
        at, which, keys = codes.distinct_runs(signs, starts, ends)
        if dropout > 0:
            pick %= np.uint64(variants)
            _, at, which = np.unique(which * variants + pick.astype(np.int64), return_index=True, return_inverse=True)
        keys = keys[at]
    if dropout > 0:
        keys = codes.mixed(keys + pick[at] * np.uint64(_ODD[2]) + np.uint64(seed))
    first, size = starts[at], (ends - starts)[at]
    counts = np.zeros(len(at), np.int64)
    blocks: list[tuple[np.ndarray, np.ndarray]] = []  # rows, and their pieces in that order
    # signs without a piece: their bytes
    lone = alone[first]
    rows = np.flatnonzero(lone)
    if len(rows):
        points = signs[first[rows]]
        points[points == OWN_MARK] = MARK
        as_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in points.tolist()]
        counts[rows] = [len(b) for b in as_bytes]
        blocks.append((rows, m.byte[np.frombuffer(b"".join(as_bytes), np.uint8)]))
    low = 0
    for width in WIDTHS:
        rows = np.flatnonzero((size > low) & (size <= width) & ~lone)
        low = width
        if len(rows):
            reach = np.minimum(first[rows][:, None] + np.arange(width), len(signs) - 1)
            grid = np.where(np.arange(width) < size[rows][:, None], symbols[reach], -1)
            ids, alive = merge_rows(m, grid, size[rows], keys[rows], dropout)
            counts[rows] = alive.sum(1)
            blocks.append((rows, ids[alive]))
    rows = np.flatnonzero((size > low) & ~lone)
    for row in rows.tolist():
        ids = merge_one(m, symbols[first[row] : first[row] + size[row]].tolist(), int(keys[row]), dropout)
        counts[row] = len(ids)
        blocks.append((np.array([row]), np.array(ids, np.int32)))
    begins = np.append(0, np.cumsum(counts))
    store = np.zeros(begins[-1], np.int32)
    for rows, ids in blocks:
        store[np.repeat(begins[rows], counts[rows]) + codes.flat_ranges(counts[rows])] = ids
    n = counts[which]
    out = store[np.repeat(begins[which], n) + codes.flat_ranges(n)]
    per_text = np.bincount(text, n, len(texts)).astype(np.int64)
    return out, np.append(0, np.cumsum(per_text))


def decode_batch(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[str]:
    """The texts that ``encode_batch`` was given, null ones as empty."""
    m = model(path)
    lengths = (m.begins[1:] - m.begins[:-1])[ids]
    raw = m.surface[np.repeat(m.begins[ids], lengths) + codes.flat_ranges(lengths)].tobytes()
    ends = np.append(0, np.cumsum(lengths))[offsets].tolist()
    # the space before each text is the library's own
    return [raw[s + 1 : e].decode("utf-8", "surrogatepass") for s, e in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, path: str, seed: int = 1, dropout: float = DROPOUT, variants: int = VARIANTS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), copy_col: str | None = None) -> DataFrame:
    """id, columns of ``carry``, n_pieces, ids and lossless: whether decoding gave the very text.

    ``copy_col`` names a column that tells rows of one id apart, which are then drawn differently.
    """
    carry = tuple(c for c in carry if c not in (id_col, text_col, "n_pieces", "ids", "lossless"))
    key = F.coalesce(F.xxhash64(F.col(id_col), *([F.col(copy_col)] if copy_col else [])), F.lit(0)).alias("__key")
    rows = docs.select(id_col, *carry, F.col(text_col).alias("__text"), key)
    kept = [f for f in rows.schema.fields if f.name not in ("__text", "__key")]
    schema = T.StructType([*kept, T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])

    def work(batches):
        for batch in batches:
            for part in codes.slices(batch, "__text", BATCH_CHARS):
                texts = part.column(len(kept)).to_pylist()
                keys = part.column(len(kept) + 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids, offsets = encode_batch(texts, path, keys, seed, dropout, variants)
                same = [a == (b or "") for a, b in zip(decode_batch(ids, offsets, path), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(np.diff(offsets)), lists, pa.array(same)], [*[f.name for f in kept], "n_pieces", "ids", "lossless"])

    return rows.mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids decode to the empty text."""
    rows = encoded.select(id_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([rows.schema[id_col], T.StructField("text", T.StringType())])

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode_batch(ids, offsets, path), pa.string())], [id_col, "text"])

    return rows.mapInArrow(work, schema)
