"""Lexical search, toxicity and repair of conversations, against plain definitions."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import dialogue, lexical, toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL))


def brute_search(docs, items, k=10):
    held = [(i, collections.Counter(t)) for i, text in docs if (t := terms_of(text))]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = {}
    own = collections.defaultdict(set)
    for i, text in items:
        own[i].update(terms_of(text))
    for i, names in own.items():
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in names if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1):
            out[i, rank] = (d, -s)
    return out


@pytest.fixture
def library():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "A1b"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(None, "w1 w2 w3"), (None, None), (5, None), (7, "w1 W1, w1;w1"), (7, "w1 W1, w1;w1"), (900, "..."), (901, "x" * 50 + " w9"), (902, "w5 " * 4000)]
    items = [(0, "w1 w2 W3 w3"), (1, "nothing-known"), (2, None), (3, "É été日本 Été naïve"), (None, "w9 w9"), (0, "w44"), (4, ""), (5, "w5 w6 w7 w8 w9 w10 a1B")]
    return docs, items


def test_search_equals_brute_force(spark, library, monkeypatch):
    docs, items = library
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, score int").repartition(5)
    told = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    want = brute_search(docs, items)

    def got():
        rows = lexical.search(table, told).collect()
        assert len(rows) == len({(r["item_id"], r["rank"]) for r in rows})
        return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}

    assert got() == want and len(want) > 30
    monkeypatch.setattr(lexical, "ITEM_BYTES", 20)  # several blocks of items
    assert got() == want
    assert lexical.search(table.limit(0), told).count() == 0 and lexical.search(table, told.limit(0)).count() == 0 and lexical.search(table, told.where("item_id = 1")).count() == 0


def test_terms_in_slices(monkeypatch):
    text = ("Ab-é" * 50 + "ü" * 100 + " \x00x{y}Z9").encode()
    whole = [t.encode() for t in terms_of(text.decode())]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(lexical, "SLICE", size)
        assert [t for part in lexical.terms(text) for t in part] == whole


# conversations: all ways to edit up to three turns
def brute_repair(turns):
    """Least (cost, audit) and the repaired turns, over all edits with up to two insertions at a place."""
    seen, told = set(), []
    for _, role, text in turns:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        body = body if re.search(r"[^ \t-\r]", text) else ""
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        told.append((role, text, fault))
    inserts = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    own = []
    for role, text, fault in told:
        more = 3 if fault == "truncated" else 0
        ways = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(more, "K", (role, text)), (more + 3, "R", ("user", text)), (more + 3, "R", ("assistant", text))]
        own.append(ways)
    names = {"u": "user", "a": "assistant"}
    best = None
    for put in itertools.product(inserts, repeat=len(told) + 1):
        for edits in itertools.product(*own):
            cost, audit, out = 0, "", []
            for k in range(len(told) + 1):
                cost += 3 * len(put[k])
                slots = put[k]
                # where in a run of deletions an insertion stands makes no difference but for the audit, which every order covers
                audit += "I" * len(slots)
                out += [(names[r], "") for r in slots]
                if k < len(told):
                    cost += edits[k][0]
                    audit += edits[k][1]
                    out += [edits[k][2]] if edits[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[0]):
                best = ((cost, audit), out)
    return best, collections.Counter(f for *_, f in told)


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def test_damage_and_repair_equal_brute_force(spark):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", None, ""], ["Yes.", "No!", "and then", "", " \n", "Why?  ", "é.", None, "x.  "]
    rows = [(c, rng.choice([None, *range(5)]) if c % 5 == 0 else t, rng.choice(roles), rng.choice(texts)) for c in range(90) for t in range(rng.randint(1, 3))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (500, 3, "user", "Twice."), (500, 3, "user", "Twice."), (500, 4, "assistant", "So."), (501, None, None, None)]
    rows = [r for r in rows if sum(x[0] == r[0] for x in rows) <= 3]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, gaps int, audit string").repartition(3)
    hurt = dialogue.damage(table)
    told = dialogue.repair(hurt)
    got = {r["conv_id"]: r for r in told.collect()}
    want = damaged(rows)
    assert got.keys() == want.keys()
    turns = collections.defaultdict(list)
    for r in dialogue.repaired(hurt, told).orderBy("conv_id", "place").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    checked = 0
    for conv, own in want.items():
        r = got[conv]
        numbers = [t for t, _, _ in own if t is not None]
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns[conv]).encode()).hexdigest()
        if len(own) <= 3:
            (least, out), faults = brute_repair(own)
            assert (r["cost"], r["audit"]) == least, (own, r, least)
            assert turns[conv] == out and [r[f] for f in ("blank", "duplicate", "truncated")] == [faults[f] for f in ("blank", "duplicate", "truncated")]
            checked += 1
    assert checked > 60
    assert dialogue.repair(dialogue.damage(table.limit(0))).count() == 0


def test_long_conversation(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"turn {t}{rng.choice(['.', ''])}") for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = dialogue.repair(table).first()
    state = {"": 0}  # row by row over the last role
    for _, _, role, text in rows:
        more = 0 if text.endswith(".") else 3
        new = {s: c + 4 for s, c in state.items()}
        for s, c in state.items():
            for to in "ua":
                cost = c + (0 if (s in ("", "a")) == (to == "u") else 3) + more + (0 if role[0] == to else 3)
                new[to] = min(new.get(to, cost), cost)
        state = new
    assert r["cost"] == min(c + (3 if s == "u" else 0) for s, c in state.items()) and r["audit"].replace("I", "").__len__() == 3000


# toxicity
def subsequence_kernel(s, t, decay=toxicity.DECAY):
    """The kernel of two strings by its definition: all pairs of equal letter triples."""

    def weights(x):
        x = "^" + x + "$"
        out = collections.Counter()
        for i, j, k in itertools.combinations(range(len(x)), 3):
            out[x[i] + x[j] + x[k]] += decay ** (k - i + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_kernel_equals_its_definition():
    strings = ["idiot", "idxiot", "banana", "the", "aaaaaa", "worthless", "pathetic"]
    for s in strings:
        one = np.zeros(toxicity.TRIPLES)
        _, codes, much = toxicity.spread([s])
        np.add.at(one, codes, much)
        assert toxicity.product(strings, one) == pytest.approx([subsequence_kernel(s, t) for t in strings])
        got = toxicity.above(strings, one, -0.3, 0.0)
        assert got == pytest.approx(np.maximum(toxicity.product(strings, one) - 0.3, 0))
    nystrom = toxicity.Nystrom(strings)
    x = nystrom.features(strings)  # exact on the landmarks
    assert x @ x.T == pytest.approx(np.array([[subsequence_kernel(a, b) for b in strings] for a in strings]), abs=1e-4)
    w = np.arange(x.shape[1], dtype=float)
    assert toxicity.product(strings, nystrom.folded(w)) == pytest.approx(x @ w, abs=1e-4)


SYLLABLES = "ba do ke li mo nu pa re si tu va we zo chi fra gle".split()
INSULTS = "idiot stupid moron worthless pathetic".split()


def speech(rng, n, insults):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    for w in insults:
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, rng.randint(20, 80), rng.sample(INSULTS, rng.randint(2, 4)) if i % 4 == 0 else []), i % 4 == 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "no id", "x"), (3, "a second text of an id", "x")], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(0, 0), (None, 1), (5, None), (7777, 1)], "doc_id long, label int")
    out = toxicity.fold(F.col("doc_id"), 5) == 0
    return rows, docs, labels, toxicity.fit(docs.where(~out), labels)


def test_toxicity_held_out(spark, judged):
    rows, docs, labels, model = judged
    truth = {i: y for i, _, y in rows}
    got = [r for r in toxicity.score(docs, model).select("doc_id", F.col("evidence"), F.element_at(F.array("doc_id"), 1)).collect()]
    assert len(got) == docs.count()
    plain = docs.select("doc_id", "text")
    scored = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(plain, model).collect()}
    held = [(s >= 0.5, truth[i]) for (i, t), s in scored.items() if i is not None and t != "a second text of an id" and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97
    again = toxicity.fit(docs.where(toxicity.fold(F.col("doc_id"), 5) != 0).repartition(2), labels)
    assert np.allclose(again.weights, model.weights) and again.offset == pytest.approx(model.offset)


def test_toxicity_of_altered_insults(spark, judged):
    rng = random.Random(8)
    texts = [speech(rng, 40, w) for w in (["idioxt", "stuupid"], ["i d i o t", "m.o.r.o.n"], ["wor-th-less", "pat*hetic!"], ["IDIOT", "Moron,"])]
    clean = [speech(rng, 40, []) for _ in range(20)]
    odd = [None, "", " \n ", "1234 ++", "ab", "z" * 100_000, "日本語のテキスト", "퟿"]
    far = " ".join("".join(rng.choices(SYLLABLES, k=3)) for _ in range(200_000)) + " idiot stupid " + speech(rng, 2000, [])
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *clean, *odd, far])], "doc_id long, text string")
    got = [r["score"] for r in toxicity.score(table, judged[3]).orderBy("doc_id").collect()]
    assert min(got[:4]) >= 0.5 and sum(s >= 0.5 for s in got[4:24]) <= 1 and max(got[24:-1]) < 0.5 and got[-1] >= 0.5
    assert all(0 <= s <= 1 for s in got) and toxicity.score(table.limit(0), judged[3]).count() == 0


def test_toxicity_without_labels(spark, judged):
    _, docs, labels, _ = judged
    none = toxicity.fit(docs, labels.where("label = 0"))
    assert {r["score"] for r in toxicity.score(docs.select("doc_id", "text"), none).collect()} == {0.0}
    assert toxicity.fit(docs.limit(0), labels).weights is None
