"""Near duplicates by ProbMinHash, banding and verification (operator 7).

Signature: the distinct five-word shingles of a text are weighted by 1 + ln(occurrences).
Each shingle is a Poisson process whose rate is its weight; its points arrive in order, each at a
random register, and a register keeps the earliest. A shingle stops as soon as its next point
is later than all registers of its text, so most take one or two points. Two registers agree
with the probability Jaccard similarity of the weighted sets.

Candidates: registers are hashed in bands; texts that share a band are candidates. What is verified
is the similarity of the plain sets, of which the weighted one is no bound: where the shingles that
differ are repeated it is as low as the repetitions make it. So each text also has the bands of its
plain set, by the same registers with all weights 1; a text without repeated shingles has them
already. Texts with equal shingle sets are one node from the start, so copies cost nothing later.

Verification: the Jaccard similarity of the two shingle sets, computed in full, must reach the
threshold. Links are found in two ways, and every pair of candidates is decided by one of them:
- leaders: each node is compared with one leader of its buckets (linear work), classes are merged,
  and so again with other leaders while that still merges many;
- the rest: buckets that still hold several classes. Where the pairs across classes are at most
  ``SPARSE`` times the members, they are compared. The texts of all others go through an exact
  prefix filter: sets that similar must share one of their rarest shingles, so what many texts
  share, like a common passage, brings nobody together. Shingles with few pairs are treated
  as such buckets. The few that whole groups of texts at the edge of the threshold have in common
  are dealt into blocks of ``BLOCK`` texts, which are compared as products of incidence matrices: no pair is
  ever a row, and of the links that hold only so many come out as tie the block's classes together, fewer
  than it has classes. Classes are merged, and so again with blocks dealt anew while that still merges many.
  Then all blocks that hold different classes meet, but for those of a key's largest class with each other.

Classes are the connected components, by label propagation with pointer jumping over tables.

Defined results: texts of one to four words have one shingle, all their words; texts without
words (null, empty, blank) have none and are each a class of its own. Rows that share an id are
one document, whose texts are all of one class. Rows with a null id are documents of their own; equal
sets share a number from 2**62 on. Class ids are the smallest id of the class. Extra columns, of any name,
are ignored, and kept by ``keep_one``. An empty table gives an empty one. Whole texts are shingled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm import codes
from tallymark.llm.store import settle, temporary
from tallymark.operators.components import components

WORDS = 5
THRESHOLD = 0.8
#: A pair whose plain sets have similarity 0.8 is missed by the plain bands with probability
#: (1 - 0.8**5)**32, about 3 in a million, whatever its weights; the weighted bands only add to that.
BANDS, ROWS = 32, 5
#: Leader rounds at most, and the share of nodes a round must merge for another to follow.
LEADER_ROUNDS, WORTH = 4, 0.02
#: Rounds at most in which each text of a dense key is compared with one block, before blocks meet.
BLOCK_ROUNDS = 8
#: Pairs across classes that a bucket may make as rows, as a multiple of its members.
SPARSE = 4
BLOCK = 256
#: Sets that stand for at least this share of the rows, so at most as many as its inverse, are joined by broadcast.
HOT = 1 / 512
NAMELESS = 1 << 62
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences) of all distinct shingles, by text; shingles are 48-bit hashes."""
    cps, offsets = codes.points(texts)
    starts, ends = codes.word_spans(cps, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, text = codes.run_hashes(cps, starts, ends), codes.owner(offsets, starts)
    n = np.bincount(text, minlength=len(texts))
    first = np.append(0, np.cumsum(n))[:-1]
    place = np.arange(len(starts)) - first[text]
    # a shingle begins at each word that has enough after it, or at the first of a short text
    at = np.flatnonzero((place + words <= n[text]) | (place == 0))
    rolled = np.zeros(len(at), np.uint64)
    for j in range(words):
        have = place[at] + j < n[text[at]]
        word = hashes[np.minimum(at + j, len(hashes) - 1)]
        rolled += np.where(have, word, np.uint64(0)) * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1))
    keyed = (text[at].astype(np.uint64) << np.uint64(48)) | (codes.mixed(rolled) & _LOW)
    keyed.sort()
    new = np.append(True, keyed[1:] != keyed[:-1])
    at = np.flatnonzero(new)
    return (keyed[at] >> np.uint64(48)).astype(np.int64), keyed[at] & _LOW, np.diff(np.append(at, len(keyed)))


def prob_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, registers: int, seed: int = 7) -> np.ndarray:
    """The shingle in each register of each text; 0 where a text has none."""
    times = np.full(n_texts * registers, np.inf)
    held = np.zeros(n_texts * registers, np.uint64)
    arrival = np.zeros(len(text))
    step = 0
    while len(text):
        salt = np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) & (2**64 - 1))
        draw = codes.mixed(shingle + salt)
        arrival = arrival - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        slot = text * registers + (codes.mixed(draw) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(arrival < times[slot])
        np.minimum.at(times, slot[early], arrival[early])
        won = early[times[slot[early]] == arrival[early]]
        held[slot[won]] = shingle[won]
        late = times.reshape(n_texts, registers).max(1)
        on = np.flatnonzero(arrival < late[text])
        text, shingle, weight, arrival = text[on], shingle[on], weight[on], arrival[on]
        step += 1
    return held.reshape(n_texts, registers)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(row, doc_id, set_a, set_b, n_shingles, bands, shingles, length, mark); shingles are 32-bit and sorted, ``row`` is a number of this run."""

    def work(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        spread = np.uint64(0xD1B54A32D192ED03) * (2 * np.arange(rows, dtype=np.uint64) + np.uint64(1))
        salts = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keyed = lambda held, n: codes.mixed((held.reshape(n, bands, rows) * spread).sum(2, dtype=np.uint64) + salts)
        for batch in batches:
            for part in codes.slices(batch, "text"):
                n = part.num_rows
                text, shingle, times = shingle_sets(part.column(1).to_pylist(), words)
                plain = keyed(prob_minhash(text, shingle, np.ones(len(text)), n, bands * rows), n)
                # only where shingles repeat do weights change anything
                repeats = np.zeros(n, bool)
                repeats[text[times > 1]] = True
                on = repeats[text]
                place = np.cumsum(repeats) - 1
                weighted = keyed(prob_minhash(place[text[on]], shingle[on], 1 + np.log(times[on]), int(repeats.sum()), bands * rows), int(repeats.sum()))
                keys, named = np.zeros((n, 2 * bands), np.uint64), np.ones((n, 2 * bands), bool)
                keys[:, :bands], named[:, bands:] = plain, False
                keys[repeats, bands:], named[repeats, bands:] = weighted, weighted != plain[repeats]
                size = np.bincount(text, minlength=n)
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                sums = [np.append(np.uint64(0), np.cumsum(codes.mixed(shingle * np.uint64(k)), dtype=np.uint64)) for k in (0x9E3779B97F4A7C15, 0x8CB92BA72F3D8DD7)]
                a, b = (codes.mixed(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
                # 32 bits that keep the order of the sorted 48
                short = ((shingle >> np.uint64(16)).astype(np.int64) - (1 << 31)).astype(np.int32)
                at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at - n, at)), part.column(0), pa.array(a), pa.array(b), pa.array(size.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(named.sum(1))).astype(np.int32)), pa.array(keys[named].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(short)), part.column(2), part.column(3)],
                    ["row", "doc_id", "set_a", "set_b", "n_shingles", "bands", "shingles", "length", "mark"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    return slim.mapInArrow(work, "row long, doc_id long, set_a long, set_b long, n_shingles long, bands array<long>, shingles array<int>, length int, mark long")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart that share an id: (length, mark); rows with equal id and text share it."""
    return [F.coalesce(F.length(text_col), F.lit(-1)).alias("length"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("mark")]


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


class _Classes:
    """The classes so far: (node, class) of all nodes that links may reach, and how links change them."""

    def __init__(self, crowd: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float):
        self.crowd, self.sets, self.threshold = crowd, sets, threshold
        self.of = settle(nodes.select("node", F.col("node").alias("class")), "dup-classes")

    def placed(self, crowd: DataFrame | None = None) -> DataFrame:
        """Rows (key, node, class) of the buckets that still hold several classes."""
        rows = settle((self.crowd if crowd is None else crowd).join(self.of, "node"), "dup-placed")
        open_ = rows.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
        return settle(rows.join(open_.select("key"), "key"), "dup-open")

    def link(self, pairs: DataFrame) -> int:
        """Verify pairs (a, b), merge the classes of those that hold; how many classes went."""
        set_of = lambda name: self.sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
        n = lambda s: F.size(s)
        pairs = settle(pairs.select("a", "b").distinct(), "dup-pairs")
        held = pairs.join(set_of("a"), "a").join(set_of("b"), "b")
        held = held.where(F.least(n("sa"), n("sb")) >= self.threshold * F.greatest(n("sa"), n("sb")))
        held = held.where(similarity(F.col("sa"), F.col("sb")) >= self.threshold).select("a", "b")
        return self.merge(held)

    def merge(self, pairs: DataFrame) -> int:
        """Merge the classes of pairs (a, b) of nodes; how many classes went."""
        at = lambda name: self.of.select(F.col("node").alias(name), F.col("class").alias(f"c{name}"))
        merged = pairs.join(at("a"), "a").join(at("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = settle(merged.distinct(), "dup-merged")
        if not merged.limit(1).count():
            return 0
        roots = components(merged)
        gone = roots.where("node <> root").count()
        moved = self.of.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        self.of = settle(moved.select("node", F.coalesce("root", "class").alias("class")), "dup-classes")
        return gone


def _leaders(rows: DataFrame, turn: int) -> DataFrame:
    """Each node and one leader of another class that it shares most buckets with."""
    order = F.xxhash64(F.col("node"), F.lit(turn)) if turn else F.col("node")
    lead = F.min(F.struct(order.alias("o"), F.col("node").alias("b"), F.col("class").alias("cb")))
    leads = rows.groupBy("key").agg(lead.alias("lead")).select("key", "lead.b", "lead.cb")
    met = rows.join(leads, "key").where("class <> cb").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n"))
    return met.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _across(rows: DataFrame) -> DataFrame:
    right = rows.select("key", F.col("node").alias("b"), F.col("class").alias("cb"))
    left = rows.select("key", F.col("node").alias("a"), F.col("class").alias("ca"))
    return left.join(right, "key").where("ca < cb").select("a", "b").distinct()


def _rarest(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Rows (key, node, class): the rarest shingles of each set, one of which similar sets must share."""
    each = nodes.join(sets, "node").select("node", "class", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    each = settle(each, "dup-tokens")
    counts = each.groupBy("key").agg(F.count("*").alias("df"))
    kept = each.join(counts, "key")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "key"))
    most = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    first = kept.select("node", "class", "key", "df", place.alias("place"), most.alias("most")).where("place <= most and df > 1")
    return first.select("key", "node", "class")


def _split(rows: DataFrame, sparse: float) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, class) of keys with several classes: those with few pairs, and the dense ones."""
    per = rows.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("k"))
    per = settle(per.where("k > 1").select("key", "n", ((F.col("n") * F.col("n") - F.col("own")) / 2 <= sparse * F.col("n")).alias("few")), "dup-sizes")
    pick = lambda few: rows.join(per.where("few" if few else "not few").select("key", F.col("n").alias("members")), "key")
    return pick(True), pick(False)


def _in_blocks(rows: DataFrame, sets: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Links (a, b) of classes among the rows of each key, each compared with one block of them: linear in the rows."""
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64(F.col("node"), F.lit(turn)), "parts").cast("int")
    rows = rows.join(parts, "key").select("key", "node", "class", own.alias("own"))
    return _compared(rows.select("*", F.col("own").alias("i"), F.col("own").alias("j")), sets, threshold)


def _between(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of classes among the rows of each key, of all blocks but those of its largest class with each other."""
    per = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    largest = per.groupBy("key").agg(F.max(F.struct("n", "class")).alias("first"), F.sum("n").alias("all")).where("first.n < all")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    largest = largest.select("key", F.col("first.class").alias("main"), parts(F.col("first.n")).alias("pm"), parts(F.col("all") - F.col("first.n")).alias("po"))
    rows = rows.join(largest, "key")
    main = F.col("class") == F.col("main")
    # blocks of the others come first, and only the others meet all blocks
    own = F.when(main, F.col("po") + F.pmod(F.xxhash64("node"), "pm")).otherwise(F.pmod(F.xxhash64("node"), "po")).cast("int")
    last = F.when(main, F.col("po")).otherwise(F.col("po") + F.col("pm")) - 1
    rows = rows.select("key", "node", "class", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return _compared(rows.select("key", "node", "class", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), sets, threshold)


def _compared(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of classes, from the texts of blocks i and j of each key: so few as tie together what is alike there."""

    def compare(table: pa.Table) -> pa.Table:
        node, group, own = (table.column(c).to_numpy() for c in ("node", "class", "own"))
        lists = table.column("shingles").combine_chunks()
        lists = lists if not isinstance(lists, pa.ChunkedArray) else pa.concat_arrays(lists.chunks)
        size = np.diff(lists.offsets.to_numpy())
        _, token, count = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        text = np.repeat(np.arange(len(node)), size)
        on = count[token] > 1
        token, text = np.unique(token[on], return_inverse=True)[1], text[on]
        order = np.argsort(token, kind="stable")
        token, text = token[order], text[order]
        left, right = (np.flatnonzero(own == k) for k in (table.column("i")[0].as_py(), table.column("j")[0].as_py())) if len(node) else (np.zeros(0, int),) * 2
        shared = np.zeros((len(left), len(right)), np.float32)
        step = 8192  # shingles at once
        for low in range(0, int(token.max(initial=-1)) + 1, step):
            a, b = np.searchsorted(token, (low, low + step))
            grid = np.zeros((len(node), step), np.float32)
            grid[text[a:b], token[a:b] - low] = 1
            shared += grid[left] @ grid[right].T
        both = shared.astype(np.float64)
        x, y = np.nonzero((both / (size[left][:, None] + size[right] - both) >= threshold) & (group[left][:, None] != group[right]))
        # classes that are alike, and from each reached class only the links to classes not reached yet
        name, at = np.unique(group, return_inverse=True)
        alike = np.zeros((len(name), len(name)), bool)
        alike[at[left[x]], at[right[y]]] = True
        alike |= alike.T
        new, links = np.ones(len(name), bool), []
        for start in np.flatnonzero(alike.any(1)):
            reached, new[start] = [start] if new[start] else [], False
            while reached:
                one = reached.pop()
                found = np.flatnonzero(alike[one] & new)
                new[found] = False
                reached.extend(found)
                links.append((np.full(len(found), name[one]), name[found]))
        a, b = (np.concatenate(side) for side in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.join(sets, "node").select("key", "i", "j", "node", "class", "own", "shingles").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sparse: float = SPARSE, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(doc_id, class_id, n_shingles), a row for each row of ``docs``."""
    return _classed(docs, id_col, text_col, threshold, sparse, leader_rounds).select("doc_id", "class_id", "n_shingles")


def _by_set(rows: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """``rows`` with what ``sets`` (set_a, set_b, n, ...) says about their set; those of the most frequent sets meet it by broadcast."""
    hot = F.col("n") >= max(HOT * total, 1000)
    often = F.broadcast(sets.where(hot).drop("n"))  # 1 / HOT rows at most
    few = rows.join(often.select("set_a", "set_b"), ["set_a", "set_b"], "left_anti").join(sets.where(~hot).drop("n"), ["set_a", "set_b"])
    return few.unionByName(rows.join(often, ["set_a", "set_b"]))


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, sparse: float = SPARSE, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """Rows of ``classes`` with their ``row_key``."""
    with temporary() as keep:
        return keep(*_found(docs, id_col, text_col, threshold, sparse, leader_rounds))


def _found(docs: DataFrame, id_col: str, text_col: str, threshold: float, sparse: float, leader_rounds: int) -> tuple[DataFrame, ...]:
    """The rows of ``_classed``, and the tables that they are read from."""
    signed = signatures(docs, id_col, text_col)
    own = F.coalesce("doc_id", F.col("set_a").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS))
    signed = settle(signed.select("*", own.alias("own")), "dup-signatures")
    full = signed.where("n_shingles > 0")
    # one node for each shingle set, named by the number of the row that stands for it
    first = full.groupBy("set_a", "set_b").agg(F.min(F.struct("own", "mark", "row")).alias("first"), F.count("*").alias("n"))
    first = settle(first.select("set_a", "set_b", F.col("first.row").alias("node"), F.col("first.own").alias("low"), "n"), "dup-nodes")
    nodes = full.withColumnRenamed("row", "node").join(first.select("node"), "node", "left_semi")
    banded = settle(nodes.select("node", F.explode("bands").alias("key")), "dup-bands")
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    crowd = settle(banded.join(shared, "key").distinct(), "dup-crowd")
    members = settle(crowd.select("node").distinct(), "dup-members")
    sets = settle(nodes.join(members, "node", "left_semi").select("node", "shingles"), "dup-sets")
    # ids with several sets: these are one document
    total = signed.count()
    same = full.groupBy("own").agg(F.min(F.struct("set_a", "set_b")).alias("low"), F.max(F.struct("set_a", "set_b")).alias("high")).where("low <> high").select("own")
    same = settle(same, "dup-shared-ids")
    several = same.limit(1).count() > 0
    star = None
    if several:
        rows = full.join(same, "own", "left_semi").select("own", "set_a", "set_b").distinct()
        rows = settle(rows.join(first.select("set_a", "set_b", "node"), ["set_a", "set_b"]), "dup-shared-sets")
        hubs = rows.groupBy("own").agg(F.min("node").alias("a"))
        star = settle(rows.join(hubs, "own").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "dup-shared")
        members = members.union(star.select("a")).union(star.select("b")).distinct()
    found = _Classes(crowd, members, sets, threshold)
    if star is not None:
        found.merge(star)
    linked = found.of.count()
    for turn in range(leader_rounds if linked else 0):
        rows = found.placed()
        if found.link(_leaders(rows, turn)) < WORTH * linked:
            break
    if linked:
        few, dense = _split(found.placed(), sparse)
        found.link(_across(few))
        left = settle(dense.select("node").distinct().join(found.of, "node"), "dup-left")
        if left.limit(1).count():
            few, dense = _split(settle(_rarest(left, sets, threshold), "dup-rare"), sparse)
            found.link(_across(few))
            dense = settle(dense.select("key", "node"), "dup-dense")
            for turn in range(BLOCK_ROUNDS):
                rows = found.placed(dense)
                if found.merge(settle(_in_blocks(rows, sets, threshold, turn), "dup-blocks")) < WORTH * rows.select("class").distinct().count():
                    break
            found.merge(settle(_between(found.placed(dense), sets, threshold), "dup-between"))
    # a class is named by the smallest id in it; every row's class is that of its set's node
    named = first.join(found.of, "node", "left").select("set_a", "set_b", "low", "n", F.coalesce("class", "node").alias("class"))
    named = settle(named, "dup-named")
    names = named.groupBy("class").agg(F.min("low").alias("class_id"))
    named = settle(named.join(names, "class").select("set_a", "set_b", "n", "class_id"), "dup-class-ids")
    columns, read = ["doc_id", "own", "set_a", "set_b", "n_shingles", "length", "mark"], [signed, named]
    out = _by_set(full.select(columns), named, total).unionByName(signed.where("n_shingles = 0").select(*columns, F.col("own").alias("class_id")))
    if several or signed.where("n_shingles = 0").limit(1).count():
        # rows without words go to the class of the other rows of their id, if it has any
        bare = out.where("n_shingles = 0").select("own").distinct()
        worded = out.where("n_shingles > 0").join(bare, "own", "left_semi").groupBy("own").agg(F.min("class_id").alias("other"))
        worded = settle(worded, "dup-bare")
        read.append(worded)
        if worded.limit(1).count():
            out = out.join(worded, "own", "left").withColumn("class_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.coalesce("other", "class_id")))
    return out.select("doc_id", "class_id", "n_shingles", "length", "mark"), *read


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with its own columns: that of the smallest id, and of its texts the longest; null ids come last."""
    names = docs.columns
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), (-F.col("length")).alias("short"), "mark")
    with temporary() as keep:
        kept = _classed(docs, "doc_id", "text", threshold).groupBy("class_id").agg(F.min(order).alias("first"))
        kept = keep(settle(kept.select(F.col("first.id").alias("kept_id"), F.col("first.mark").alias("kept_mark")), "dup-kept"))
    # rows with equal id and text have one class and one key
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("own"), F.col("doc_id").cast("long").alias("kept_id"), row_key("doc_id", "text")[1].alias("kept_mark"))
    rows = packed.join(kept.withColumnsRenamed({"kept_id": "i", "kept_mark": "m"}), F.col("kept_id").eqNullSafe(F.col("i")) & (F.col("kept_mark") == F.col("m")), "left_semi")
    hashed = F.lit(0) if "map<" in docs.schema.simpleString() else F.xxhash64("own")  # maps have no hash
    first = Window.partitionBy("kept_id", "kept_mark").orderBy(hashed)
    rows = rows.select("own", F.row_number().over(first).alias("n")).where("n = 1")
    return rows.select(*[F.col("own")[c].alias(c) for c in names])
