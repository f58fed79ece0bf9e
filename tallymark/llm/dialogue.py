"""Repair of the turns of conversations (operator 13).

A conversation is to read user, assistant, user, assistant, with one system turn before it at most, or to
be empty. A turn is kept, reroled or deleted, and empty turns are inserted, at the least cost. The choice is a
dynamic programme over the turns that are retained: for each last role the best way so far is held as its cost
less the prefix sum of deletions, so that turns left out in between cost nothing to price, and a running
minimum for each role is all that is kept. The pair of last and next role says how many turns are to be
inserted. Equal costs are decided by the audit, the string of edits: ways that end in different roles never
have audits of which one starts the other, so that their order among each other, three or four ranks, decides all later ties.

Conversations are told apart by a shuffle on their id and read as a sorted stream. What a task holds of one is the
links of at most four audits and as many running hashes, not its texts.

Defined results: a null role or text is one space, and so are a null id and turn in the key that damages a row, and nowhere
else; rows with a null id are one conversation. Rows are in the order of turn (null first), role and text, so that repeated
rows stand side by side and each but the first is a duplicate. A role without a letter of its own (empty, a space, any other
initial than s, u, a) can't be kept. Extra columns are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Turns to insert between the last role ("" at the start) and the next one, by their initials; what is not listed can't be.
BETWEEN = {"s": {"": ""}, "u": {"": "", "s": "", "a": "", "u": "a"}, "a": {"u": "", "": "u", "s": "u", "a": "u"}}
#: Turns to insert after the last one.
AFTER = {"": "", "a": "", "u": "a", "s": "ua"}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): seeded faults; ``lost`` rows are dropped ones and hold nothing but the id."""
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(put("conv_id"), F.lit(":"), put("turn")).cast("binary")) % 20
    text, role = put("text"), put("role")
    told = rows.select(
        "conv_id", F.when(kind != 0, F.col("turn")).alias("turn"), F.when(kind == 4, F.lit("user")).when(kind != 0, role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).when(kind != 0, text).alias("text"), (kind == 0).alias("lost"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )
    return told.select("conv_id", "turn", "role", "text", "lost", F.explode(F.array_repeat("lost", F.col("times"))).alias("again")).drop("again")


def _whole(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and lost, without nulls in role and text."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *plain, F.col("lost") if "lost" in rows.columns else F.lit(False).alias("lost"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``fault``: blank, duplicate, truncated or null, in tasks that hold whole conversations."""
    tail = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    seen = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault: Column = F.when(tail == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~tail.isin(".", "!", "?"), "truncated")
    return _whole(rows).repartition("conv_id").withColumn("fault", fault)


class Choice:
    """The dynamic programme of one conversation, fed turn by turn."""

    def __init__(self) -> None:
        # last role: (cost less 4 a turn so far, rank of the audit, links of the audit, running hash)
        self.best: dict[str, tuple[int, int, tuple | None, object]] = {"": (0, 0, None, hashlib.sha256())}
        self.n = 0

    def turn(self, role: str, text: str, fault: str | None) -> None:
        ways = {state: [(cost, rank, "D", state)] for state, (cost, rank, _, _) in self.best.items()}
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            for to, reach in BETWEEN.items():
                own = role[:1] == to
                if own or to in ROLES:
                    letter, price = ("K", extra) if own else ("R", extra + REROLE)
                    for state, between in reach.items():
                        if state in self.best:
                            cost, rank, _, _ = self.best[state]
                            ways.setdefault(to, []).append((cost + INSERT * len(between) + price - DELETE, rank, "I" * len(between) + letter, state))
        chosen = {to: min(found) for to, found in ways.items()}
        order = {to: k for k, to in enumerate(sorted(chosen, key=lambda to: chosen[to][1:3]))}
        best = {}
        for to, (cost, _, edits, state) in chosen.items():
            _, _, links, digest = self.best[state]
            if edits != "D":
                digest = digest.copy()
                lines = [f"{ROLES[r]}:" for r in BETWEEN[to][state]] + [f"{role if edits[-1] == 'K' else ROLES[to]}:{text}"]
                digest.update((("\n" if links else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                links = (links, self.n, edits)
            best[to] = (cost, order[to], links, digest)
        self.best, self.n = best, self.n + 1

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired turns)."""
        cost, _, state = min((cost + INSERT * len(AFTER[state]), rank, state) for state, (cost, rank, _, _) in self.best.items())
        _, _, links, digest = self.best[state]
        parts, after = ["I" * len(AFTER[state])], self.n
        while links:
            links, at, edits = links
            parts += ["D" * (after - at - 1), edits]
            after = at
        if AFTER[state]:
            digest = digest.copy()
            digest.update("".join(f"\n{ROLES[r]}:" for r in AFTER[state]).encode())
        return cost + DELETE * self.n, "".join([*parts, "D" * after][::-1]), digest.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost, audit and hash of the repaired turns, one row a conversation."""
    told = faults(rows).sortWithinPartitions("conv_id", F.col("lost"), F.col("turn").asc_nulls_first(), "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)))
    told = told.select("conv_id", "lost", "turn", "role", "text", "fault")
    key = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    names = ["conv_id", *(part.split()[0] for part in SCHEMA.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, choice, counts, turns, initial = None, None, {}, [], ""  # of the conversation that is being read

        def close() -> None:
            cost, audit, digest = choice.end()
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((now, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, digest))

        def out(kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
            done.clear()
            return batch

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, lost, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if choice is None or conv != now:
                    if choice is not None:
                        close()
                    now, choice, turns, initial = conv, Choice(), [], None
                    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                if lost:
                    continue
                if turn is not None:
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                if fault:
                    counts[fault] += 1
                if initial is not None and initial + role[:1] not in LEGAL:
                    counts["illegal"] += 1
                initial = role[:1]
                choice.turn(role, text, fault)
            if done:
                yield out(kind)
        if choice is not None:
            close()
            yield out(kind)

    return told.mapInArrow(work, T.StructType([key, *T._parse_datatype_string(SCHEMA).fields]))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that the audits of ``repair(rows)`` leave, reroled or kept, or inserted.

    An audit is the head of its conversation's rows, so that it is sent once and not with each of them.
    """
    heads = audits.select("conv_id", F.lit(True).alias("head"), F.lit(False).alias("lost"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    own = _whole(rows).select("conv_id", F.lit(False).alias("head"), "lost", "turn", "role", "text").where("not lost")
    told = heads.union(own).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string("place bigint, role string, text string, edit string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, last, place = "", 0, "", 0
        for batch in batches:
            got = []

            def inserted(conv, got=got) -> None:
                nonlocal at, last, place
                while audit[at : at + 1] == "I":
                    last = "a" if last == "u" else "u"
                    got.append((conv, place, ROLES[last], "", "I"))
                    at, place = at + 1, place + 1

            for conv, head, _, _, role, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if head:
                    audit, at, last, place = text, 0, "", 0
                else:
                    inserted(conv)
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        last = role[:1] if edit == "K" else "a" if last == "u" else "u"
                        got.append((conv, place, role if edit == "K" else ROLES[last], text, edit))
                        place += 1
                if set(audit[at : at + 3]) <= {"I"}:
                    inserted(conv)  # what the audit ends with has no row after it
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], [f.name for f in schema.fields])

    return told.mapInArrow(work, schema)
