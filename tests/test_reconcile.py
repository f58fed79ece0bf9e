"""Matching, verification, reports, scoring, feedback: fixtures, and brute force where there is one."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.operators import feedback, match, verify
from tallymark.operators.components import components
from tallymark.plans import report, score
from tallymark.streaming.groups import Groups
from tallymark.tables import settle, spread_join

NO = (None,) * 5


def doc(i, order=None, bl=None, ref=None, cont=None, seal=None, shipper="Acme Corp", consignee="Beta LLC", vessel="MV Test", net=6402.0, gross=7000.0, cartons=100, value=None, currency="EUR", items=(), kind="bill_of_lading", group=None):
    row = (f"d{i}", f"/c/S0{(group or 1)}_{i}.docx", kind, "docx", (order, bl, ref, cont, seal), (shipper, consignee), (vessel, None, None, None, None), [tuple(x) for x in items], (cartons, net, gross, value, currency), 1.0, None, i)
    return (*row, f"G{group or 1}")


def frame(spark, *docs):
    return spark.createDataFrame(list(docs), schema.CANONICAL + ", group_id string")


def found(spark, *docs, tolerance=0.0):
    return [r.asDict() for r in verify.ordered(verify.findings(frame(spark, *docs), tolerance)).orderBy("group_id", "place").collect()]


def indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and len({find(x) for x in range(1000, 1061)}) == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_match(spark):
    docs = [
        doc(0, order="ORD-2026-77566", bl="BL1", cont="C1"), doc(1, order="ord/2026 77566", bl="BL1", cont="C1"), doc(2, order="ORD-2026-77567", bl="BL1", cont="C1"),
        doc(3, order="ORD-2025-00001", ref="R9"), doc(4, order="ORD-2099-55555", ref="r-9"), doc(5), doc(6, order="ORD-2026-77565"), doc(7, order="ZZZ"), doc(8, seal="S1"), doc(9, seal="S1"),
    ]
    got = {r["doc_id"]: r for r in match.match(frame(spark, *docs)).collect()}
    groups = {}
    for k, r in got.items():
        groups.setdefault(r["group_id"], set()).add(k)
    assert {frozenset(v) for v in groups.values()} == {frozenset(x) for x in ({"d0", "d1", "d2", "d6"}, {"d3", "d4"}, {"d5"}, {"d7"}, {"d8"}, {"d9"})}
    assert got["d0"]["certainty"] == 1.0 and got["d2"]["certainty"] == 1.0 and got["d5"]["certainty"] == 0.2 and got["d6"]["certainty"] == 0.4 and got["d6"]["absorbed"]
    assert got["d0"]["group_id"] == "G06" and sorted({r["group_rank"] for r in got.values()}) == list(range(1, 7))
    assert len({r["group_id"] for r in match.match(frame(spark, *docs), fuzzy=False).collect()}) == 7
    shuffled = {r["doc_id"]: r["group_id"] for r in match.match(frame(spark, *docs[::-1]).repartition(5)).collect()}
    assert shuffled == {k: r["group_id"] for k, r in got.items()}
    assert match.match(frame(spark, docs[0]).limit(0)).count() == 0


def test_near_misses_equal_brute_force(spark):
    rng = random.Random(8)
    signs = "ABC0123456789"
    shared = [(i, f, k, "".join(rng.choices(signs, k=rng.randint(1, 14)))) for i in range(60) for k, f in enumerate(match.FIELDS[:2])]

    def bent(s):
        s = list(s)
        for _ in range(rng.randint(0, 2)):
            s[rng.randrange(len(s))] = rng.choice(signs)
        return "".join(s) + rng.choice(["", "", "7"])

    alone = [(1000 + i, f, k, bent(rng.choice(shared)[3])) for i in range(80) for k, f in enumerate(match.FIELDS[:2])]
    got = {r["doc_ord"]: r["root"] for r in match.near_misses(spark.createDataFrame(alone, "doc_ord long, field string, field_no int, key string"), spark.createDataFrame(shared, "root long, field string, field_no int, key string")).collect()}
    want = {}
    for d in {a[0] for a in alone}:
        best = max(((indel(a[3], s[3]), -s[0], -a[2]) for a in alone if a[0] == d for s in shared if s[1] == a[1]), default=None)
        if best and best[0] * 100 >= match.THRESHOLD:
            want[d] = -best[1]
    assert got == want and len(want) > 20


LONE, SHARED = "doc_ord long, field string, field_no int, key string", "root long, field string, field_no int, key string"


@pytest.mark.parametrize("prefix, low, high, most", [("", 20, 60, 9), ("REF2024-", 12, 18, 6)])
def test_long_near_misses_equal_brute_force(spark, prefix, low, high, most):
    rng = random.Random(3)
    shared = [prefix + "".join(rng.choices("0123456789", k=rng.randint(low, high))) for _ in range(80)]

    def bent(s):
        s = list(s)
        for _ in range(rng.randint(0, most)):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("0123456789")])
        return "".join(s)

    alone = [bent(rng.choice(shared)) for _ in range(60)]
    got = {r["doc_ord"]: r["root"] for r in match.near_misses(spark.createDataFrame([(1000 + i, "bl_no", 0, k) for i, k in enumerate(alone)], LONE), spark.createDataFrame([(i, "bl_no", 0, k) for i, k in enumerate(shared)], SHARED)).collect()}
    best = {1000 + j: max((indel(a, s), -i) for i, s in enumerate(shared)) for j, a in enumerate(alone)}
    assert got == {d: -i for d, (score, i) in best.items() if score * 100 >= match.THRESHOLD} and 20 < len(got)


def test_long_identifiers_meet_few_others(spark):
    rng = random.Random(5)
    sides = [spark.createDataFrame([("bl_no", "".join(rng.choices("0123456789", k=30)), 30) for _ in range(1500)], "field string, key string, n int") for _ in "xy"]
    plan = spark.createDataFrame([("bl_no", 30, 30)], "field string, nx int, ny int")
    assert match._met(*sides, plan, match.THRESHOLD / 100).count() <= 1500  # of 2.25 million pairs


def _shuffled(spark):
    """Rows that all stages so far have shuffled."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_long_identifiers_shuffle_a_row_for_each_piece(spark):
    rng = random.Random(15)
    sides = [spark.createDataFrame([("bl_no", "".join(rng.choices("0123456789", k=30)), 30) for _ in range(n)], "field string, key string, n int") for n in (1500, 100)]
    plan = spark.createDataFrame([("bl_no", 30, 30)], "field string, nx int, ny int")
    before = _shuffled(spark)
    match._met(*sides, plan, match.THRESHOLD / 100).count()
    assert _shuffled(spark) - before < 20 * 1500 + 100 * 100  # rests are 168 of each string on one side and about 500 on the other


def test_pieces_of_very_many_strings_meet_in_blocks(spark, monkeypatch):
    """All strings end alike and start with one of two letters, so that cells are hot on both sides."""
    monkeypatch.setattr(match, "CELL", 7)
    rng = random.Random(16)
    keys = ["".join(rng.choices("AB", k=24)) for _ in range(40)]
    bent = [k[:5] + "C" + k[6:] for k in keys[:30]] + ["".join(rng.choices("CD", k=24))]
    sides = [spark.createDataFrame([("bl_no", k, 24) for k in some], "field string, key string, n int").distinct() for some in (keys, bent)]
    plan = spark.createDataFrame([("bl_no", 24, 24)], "field string, nx int, ny int")
    got = {(r["x"], r["y"]) for r in match._met(*sides, plan, match.THRESHOLD / 100).collect()}
    want = {(x, y) for x in keys for y in bent if indel(x, y) >= match.THRESHOLD / 100}
    assert want <= got and len(want) >= 30


def test_hot_keys_are_split(spark):
    many = spark.range(60_000, numPartitions=6).select((F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1)).alias("k"), "id")
    many = settle(many.unionByName(spark.createDataFrame([(None, 1)], "k long, id long")), "many")
    one = settle(many.groupBy("k").agg(F.count("*").alias("n")), "one")
    got = settle(spread_join(many, one, ["k"], hot=1000).withColumn("part", F.spark_partition_id()), "met")
    assert got.count() == 60_000 and got.select("k", "id", "n").exceptAll(many.where("k is not null").join(one, "k").select("k", "id", "n")).count() == 0
    sizes = sorted(r["count"] for r in got.where("k = -1").groupBy("part").count().collect())
    assert len(sizes) >= 2 and sizes[-1] < 5 * sizes[len(sizes) // 2]


def test_components_with_hubs(spark):
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7000 + rng.randrange(200), 7000 + rng.randrange(200)) for _ in range(150)] + [(9, 9), (1, 0)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(edges, "a long, b long"), hot=50).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_groups_over_batches(spark, tmp_path):
    rng = random.Random(1)
    pick = lambda name, n: rng.choice([None, f"{name}{rng.randrange(n)}"])
    docs = [doc(i, order=pick("ORD-2026-000", 40), bl=pick("BLNO0", 30), ref=pick("r", 60), cont="N/A" if i % 9 == 0 else None) for i in range(60)] + [doc(60, order="ORD-2026-0001"), doc(61)]
    every = frame(spark, *docs)
    want = {r["doc_id"]: tuple(r) for r in match.match(every).collect()}
    kept = Groups(spark, str(tmp_path / "groups"))
    number = {d[-2]: rng.randrange(3) for d in docs}
    for n in (0, 1, 2, 1):
        part = [d for d in docs if number[d[-2]] == n]
        kept.absorb(frame(spark, *part), n)
    assert kept.batches() == [0, 1, 2]
    assert {r["doc_id"]: tuple(r) for r in kept.groups(every).collect()} == want
    roots = {r["doc_ord"]: r["root"] for r in kept.documents().collect()}
    own = {r["node"]: r["root"] for r in components(match.edges(match.identifier_rows(every))).collect()}
    assert roots == {d[-2]: own.get(d[-2], d[-2]) for d in docs}


def test_votes(spark):
    base = dict(order="ORD-001", cont="CONT-001")
    assert found(spark, *(doc(i, **base) for i in range(3))) == []
    rows = found(spark, doc(0, **base), doc(1, order="ord 001", cont="CONT-001"), doc(2, order="ORD-002", cont="CONT-001"))
    assert [(r["field"], r["doc_a"], r["value_a"], r["doc_b"], r["value_b"], r["severity"]) for r in rows] == [("identifiers.order_no", "d0", "ORD-001", "d2", "ORD-002", "high")]
    assert rows[0]["message"] == "identifiers.order_no mismatch: 2 of 3 docs show ORD-001, doc shows ORD-002"
    two = found(spark, doc(0, net=6402.0), doc(1, net=6302.0))
    assert two[0]["message"] == "totals.net_kg mismatch: 6402.0 vs 6302.0 (ambiguous -- only 2 docs)"
    assert found(spark, doc(0), doc(1, net=6402.01), tolerance=0.02) == [] and len(found(spark, doc(0), doc(1, net=6403.0), tolerance=0.02)) == 1
    assert len(found(spark, doc(0), doc(1, cartons=101), tolerance=5.0)) == 1
    assert found(spark, doc(0, net=None, shipper=None), doc(1, shipper=None)) == []
    assert [r["value_b"] for r in found(spark, doc(0, order="---"), doc(1, order="ORD-1"), doc(2, order="ORD-1"))] == ["---"]
    mixed = found(spark, doc(0), doc(1, vessel="MV Other", shipper="Other", net=1.0), doc(2))
    assert [(r["severity"], r["field"]) for r in mixed] == [("high", "totals.net_kg"), ("medium", "parties.shipper"), ("low", "logistics.vessel")]
    tie = found(spark, doc(3, currency="USD"), doc(4, currency="EUR"), doc(5, currency="EUR"), doc(6, currency="USD"))
    assert [(r["doc_a"], r["doc_b"]) for r in tie] == [("d3", "d4"), ("d3", "d5")]
    assert found(spark, doc(0), doc(1, net=1.0, group=2)) == []


def test_items(spark):
    a, b = ("Spaghetti", "L1", 10, 5.0, 6.0, 2.5, 1, 25.0), ("Penne", None, 3, 1.0, 1.5, None, None, None)
    assert found(spark, doc(0, items=[a, b]), doc(1, items=[a, ("penne ", None, 3, 1.0, 1.5, None, None, None)])) == []
    rows = found(spark, doc(0, items=[a]), doc(1, items=[a]), doc(2, items=[(*a[:3], 5.5, *a[4:])]))
    assert [(r["field"], r["doc_b"], r["severity"]) for r in rows] == [("line_items[lot=L1].net_kg", "d2", "high")]
    rows = found(spark, doc(0, items=[a]), doc(1, items=[("spaghetti", "L2", 11, 5.0, 6.0, 2.5, 9, 25.0)]))
    assert [(r["severity"], r["field"]) for r in rows] == [("high", "line_items[desc=spaghetti].cartons"), ("low", "line_items[lot=L1]"), ("low", "line_items[lot=L2]")]
    assert rows[1]["doc_a"] == rows[1]["doc_b"] == "d0" and rows[1]["message"] == "Line item 'L1' only found in one document"
    twice = found(spark, doc(0, items=[(*a[:2], 99, *a[3:]), a]), doc(1, items=[a]))
    assert [r["field"] for r in twice] == ["line_items[desc=spaghetti]"]


def test_items_that_all_have_alike_become_no_rows(spark):
    a, b, c = ("Spaghetti", "L1", 10, 5.0, 6.0, 2.5, 1, 25.0), ("Penne", "L2", 3, 1.0, 1.5, None, None, None), ("Fusilli", None, 3, 1.0, 1.5, 2.0, None, None)
    docs = [doc(0, items=[a, b, c]), doc(1, items=[b, c]), doc(2, items=[(*b[:3], 1.25, *b[4:]), c])]
    rows = verify.item_rows(frame(spark, *docs)).collect()
    assert sorted((r["doc_id"], r["prefix"], r["several"]) for r in rows) == [("d0", "line_items[desc=spaghetti]", False), ("d0", "line_items[lot=L1]", False), *((f"d{i}", "line_items[lot=L2]", True) for i in range(3))]
    assert [(r["field"], r["doc_b"]) for r in found(spark, *docs)] == [("line_items[lot=L2].net_kg", "d2"), ("line_items[desc=spaghetti]", "d0"), ("line_items[lot=L1]", "d0")]


@pytest.mark.parametrize("many", [0, 1 << 30])
def test_findings_of_many_groups(spark, monkeypatch, many):
    monkeypatch.setattr(verify, "MANY", many)
    one = ("Spaghetti", "L1", 10, 5.0, 6.0, 2.5, 1, 25.0)
    alone = [doc(0, items=[one]), doc(1, group=2), doc(2, items=[one], group=2), doc(3, group=3), doc(4, items=[one], group=3)]  # most groups differ, and a group of one has no findings
    assert {(r["group_id"], r["doc_b"]) for r in found(spark, *alone)} == {("G2", "d2"), ("G3", "d4")}
    docs = [d for g in range(1, 30) for d in (doc(3 * g, group=g), doc(3 * g + 1, group=g), doc(3 * g + 2, net=1.0 if g % 3 else 6402.0, group=g))]
    assert [r["doc_b"] for r in found(spark, *docs)] == sorted((f"d{3 * g + 2}" for g in range(1, 30) if g % 3), key=lambda d: f"G{(int(d[1:]) - 2) // 3}")


def test_verdicts_and_reports(spark):
    docs = [doc(0, order="ORD-1", bl="B1"), doc(1, order="ORD-1", bl="B1", kind="packing_list"), doc(2, order="ORD-2", bl="B1", kind="commercial_invoice"), doc(3, vessel="A", group=2), doc(4, vessel="B", group=2), doc(5, group=3), doc(6, group=4), doc(7, group=4)]
    members = frame(spark, *docs)
    rows = verify.findings(members)
    got = {r["group_id"]: r for r in verify.verdicts(rows, members).collect()}
    assert [(got[g]["verdict"], got[g]["suspect_doc_ids"]) for g in ("G1", "G2", "G3", "G4")] == [("FAIL", ["d2"]), ("PASS", ["d3", "d4"]), ("PASS", []), ("PASS", [])]
    results = report.results(members, rows)
    report.check(results)
    by = {r["group_id"]: r for r in results.collect()}
    assert by["G1"]["identifiers"]["order_no"] == "ORD-1" and by["G1"]["totals"]["net_kg"] == "6402.0" and len(by["G1"]["documents"]) == 3 and by["G4"]["identifiers"]["order_no"] is None
    text = {r["group_id"]: r["text"] for r in report.markdown(results).collect()}
    assert "| identifiers.order_no | `/c/S01_2.docx` | ORD-2 | ORD-1 | high |" in text["G1"] and "Likely error: the Commercial Invoice" in text["G1"] and "order no disagrees with 2 other documents" in text["G1"]
    assert "minor observation(s)" in text["G2"] and "Insufficient documents" in text["G3"] and "All shared fields agree across 2 documents." in text["G4"]
    drafts = {r["group_id"]: r["text"] for r in report.corrections(results).collect()}
    assert list(drafts) == ["G1"] and 'Commercial Invoice (order no): shows "ORD-2" but should be "ORD-1" per the other 2 documents in this shipment.' in drafts["G1"]
    assert drafts["G1"].startswith("Subject: Correction needed — Order ORD-1 / B/L B1\n\nDear Acme Corp,")
    assert report.summary(results).first().asDict() == {"shipments": 4, "passed": 3, "failed": 1} and "4 shipments" in report.html(results)
    assert json.loads(report.results_json(results.where("group_id = 'G1'")).first()["json"])["verdict"] == "FAIL"


def test_report_files(spark, tmp_path):
    members = frame(spark, doc(0, net=1.0), doc(1))
    report.write(report.results(members, verify.findings(members)), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "corrections")).count() == 1 and spark.read.json(str(tmp_path / "summary")).first()["failed"] == 1


def test_score(spark):
    docs = [doc(0, order="ORD-1"), doc(1, order="ORD-1"), doc(2, order="ORD-9", kind="commercial_invoice"), doc(3, group=2), doc(4, group=2), doc(5, net=1.0, group=3), doc(6, net=2.0, group=3)]
    members = frame(spark, *docs)
    rows = verify.findings(members)
    verdicts, numbers = verify.verdicts(rows, members), score.shipments(members)
    key = spark.createDataFrame([(1, "", "", "", True, "invoice", ["Order No altered"]), (2, "", "", "", False, None, []), (3, "", "", "", False, None, []), (4, "", "", "", True, "bill_of_lading", ["x"])], schema.ANSWER_KEY)
    table = {r["shipment"]: r for r in score.confusion(key, verdicts, numbers).collect()}
    assert [table[i]["predicted_verdict"] for i in (1, 2, 3, 4)] == ["FAIL", "PASS", "FAIL", "N/A"] and [table[i]["correct"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    located = score.localization(key, rows, members, verdicts, numbers)
    assert [(r["shipment"], r["found_doc_type"], r["found_field"], r["correct"]) for r in located.collect()] == [(1, "commercial_invoice", "order_no", True)]
    card = score.scorecard(score.confusion(key, verdicts, numbers), located).first().asDict()
    assert card["recall"] == "1/2" and card["precision"] == 0.5 and card["f1"] == 0.5 and card["grouping_accuracy"] == "3/4" and card["localization_accuracy"] == "1/1" and not card["overall_pass"]
    words = ["BL No x", "gross weight", "amount", "unit price", "cartons", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(score.expected_field(F.col("w"))).collect()]
    assert got == ["bl_no", "gross_kg", "value", "unit_price", "cartons", None, None]
    pairs = score.pairwise(members, F.col("group_id")).first()
    assert pairs["precision"] == pairs["recall"] == 1.0


def test_feedback(spark, tmp_path):
    log = str(tmp_path / "log")
    names = [c.split()[0] for c in schema.FEEDBACK.split(", ")]
    row = lambda t, f, v, d="packing_list": dict(zip(names, (t, "S1", f, v, "note", "", "", "", d), strict=True))
    rows = spark.createDataFrame([row("2024-01-30T10:00:00+00:00", "identifiers.order_no", "confirmed"), row("2024-01-30T11:00:00+00:00", "totals.net_kg", "corrected"), row("2024-01-29T10:00:00+00:00", "identifiers.order_no", "confirmed", ""), row("not a time", "identifiers.bl_no", "confirmed"), row("2020-01-01T00:00:00+00:00", "totals.value", "rejected")], schema.FEEDBACK)
    feedback.append(rows, log)
    (tmp_path / "log" / "bad.json").write_text('\n{"broken\n')
    with pytest.raises(ValueError, match="maybe"):
        feedback.append(spark.createDataFrame([row("x", "f", "maybe")], schema.FEEDBACK), log)
    read = feedback.read(spark, log)
    assert read.where("verdict is not null").count() == 5
    recent = feedback.recent(read.where("verdict is not null"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    assert feedback.overall(recent).first().asDict() == {"total_reviews": 4, "confirmed": 3, "rejected": 0, "corrected": 1, "accuracy": 0.75}
    assert {r["doc_type"]: r["error_rate"] for r in feedback.error_rate(recent, "doc_type").collect()} == {"packing_list": 0.333}
    assert [(r["date"], r["count"]) for r in feedback.trend(recent).collect()] == [("2024-01-29", 1), ("2024-01-30", 2), ("not a time", 1)]
    feedback.save_overrides(feedback.overrides(recent), str(tmp_path / "over"))
    labels, tolerance = feedback.load_overrides(spark, str(tmp_path / "over"))
    assert labels == {"net kg": "net_kg", "net_kg": "net_kg"} and tolerance == 0.02
    assert feedback.load_overrides(spark, str(tmp_path / "none")) == ({}, 0.0)
    example = json.loads(feedback.training_examples(recent, ["net_kg"]).first()["example"])
    assert example["messages"][2]["content"] == '{"net_kg": "net_kg"}' and example["metadata"]["verdict"] == "corrected"
    assert "accuracy 75.0%" in feedback.dashboard(recent) and feedback.overall(recent.limit(0)).first()["accuracy"] == 0.0
    assert feedback.last(read, 1).count() == 1


def test_one_error_is_found_where_it_is(spark):
    rng = random.Random(2)
    for field, other in itertools.islice(itertools.cycle([("order", "ORD-9"), ("cont", "C-9"), ("net", 1.5), ("cartons", 7), ("shipper", "Else"), ("currency", "USD")]), 6):
        bad = rng.randrange(4)
        base = dict(order="ORD-1", cont="C-1")
        rows = found(spark, *(doc(i, **(base | ({field: other} if i == bad else {}))) for i in range(4)))
        assert [r["doc_b"] for r in rows] == [f"d{bad}"]


def _likeness(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(a) + len(b))


@pytest.mark.parametrize("most", [2000, 0])
def test_near_misses_equal_brute_force_at_all_lengths(spark, monkeypatch, most):
    """Lengths 1 to 60, repeated grams, one to eight changes: by leaving signs out and by grams alone."""
    import random

    from tallymark.operators import match as ma

    monkeypatch.setattr(ma, "MOST_RESTS", most)
    rng, shared, alone = random.Random(6), [], []
    for n in [*range(1, 24), 30, 34, 40, 47, 60]:
        for signs in ("01", "0123456789", "AB"):
            base = "".join(rng.choices(signs, k=n)) if rng.random() < 0.7 else (signs * n)[:n]
            shared.append(base)
            for changes in (1, 2, 8):
                new = list(base)
                for _ in range(changes):
                    at = rng.randrange(len(new) + 1)
                    new[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(signs), "Z"])
                alone.append("".join(new) or "0")
    shared = sorted(set(shared))
    alone_rows = [(1000 + i, ("bl_no", "order_no")[i % 2], i % 2, k) for i, k in enumerate(alone)]
    shared_rows = [(i, f, no, k) for i, k in enumerate(shared) for no, f in enumerate(("bl_no", "order_no"))]
    got = ma.near_misses(spark.createDataFrame(alone_rows, "doc_ord long, field string, field_no int, key string"), spark.createDataFrame(shared_rows, "root long, field string, field_no int, key string"))
    want = {}
    for o, _, _, k in alone_rows:
        best = max((round(_likeness(k, y), 12), -i) for i, y in enumerate(shared))
        if best[0] >= 0.85:
            want[o] = -best[1]
    assert {r["doc_ord"]: r["root"] for r in got.collect()} == want and len(want) > 50


def test_stars_are_components_without_a_round(spark, monkeypatch):
    from tallymark.operators import components as module

    written = []
    monkeypatch.setattr(module, "settle", lambda df, name: written.append(name) or settle(df, name))
    stars = spark.createDataFrame([(1, 2), (1, 3), (9, 7), (8, 7), (7, 8), (5, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(stars).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}
    assert "both" not in written
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):  # what hangs also holds, or hangs twice
        assert {r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {1}


def test_neighbours_of_keys_that_follow_each_other(spark, monkeypatch):
    made, plain = [], match._by_omission

    def counted(*a):
        pairs = plain(*a)
        made.append(pairs.where("x <> 'ORD000000Q05'").count())
        return pairs

    monkeypatch.setattr(match, "_by_omission", counted)
    shared = spark.createDataFrame([(i, "order_no", 0, f"ORD{i:09}") for i in range(1000)], "root long, field string, field_no int, key string")
    alone = [(5000 + i, "order_no", 0, f"ORD{i:09}Z") for i in range(0, 1000, 97)] + [(7000, "order_no", 0, "ORD000000Q05")]
    got = {r["doc_ord"]: r["root"] for r in match.near_misses(spark.createDataFrame(alone, "doc_ord long, field string, field_no int, key string"), shared).collect()}
    assert got == {5000 + i: i for i in range(0, 1000, 97)} | {7000: 5}
    # the stray with a wrong sign inside is the only one that goes on to pairs which are less alike
    assert sum(made) == len(alone) - 1


def test_only_documents_of_failed_groups_are_met_again(spark, monkeypatch):
    from tallymark import tables
    from tallymark.operators import verify as ve
    from tallymark.plans import queries, report

    folder = "/root/testdata/sf0.001"
    members = queries._members(spark, folder).where("doc_ord < 2000")
    plain = ve.findings(members).collect()
    read = []
    whole = report.results
    monkeypatch.setattr(report, "results", lambda some, found: read.append(some.count()) or whole(some, found))
    for many in (tables.MANY, 1):  # broadcast, and by bits
        monkeypatch.setattr(tables, "MANY", many)
        found = ve.findings(members)
        assert sorted(map(str, found.collect())) == sorted(map(str, plain))
        want = sorted(map(str, whole(members, found).where("verdict = 'FAIL'").collect()))
        assert sorted(map(str, report.failed(members, found).collect())) == want and want
        assert read.pop() == 3 * len(want) < members.count()
    keys = spark.range(0, 3000, 3).selectExpr("CAST(id AS string) AS k")
    assert tables.of_keys(spark.range(3000).selectExpr("CAST(id AS string) AS k").union(spark.sql("SELECT CAST(NULL AS string)")), keys, "k", 1000).count() == 1000


def test_clusters_agree_anew_where_they_take_documents_in(spark):
    def doc(number, bill, order):
        return (f"d{number}", number, (order, bill, None, None, None))

    rows = [doc(1, "BL1234567X", "QQ"), doc(2, "BL1234567", "PP"), doc(3, "BL1234567", None), doc(4, None, None), doc(5, "C-77", "RR"), doc(6, "c 77", "RR")]
    docs = spark.createDataFrame(rows, "doc_id string, doc_ord long, identifiers struct<order_no:string,bl_no:string,reference:string,container_no:string,seal_no:string>")
    keys = {r["doc_ord"]: r["keys"] for r in match.keyed(docs).collect()}
    assert keys[5] == ["C77", "RR", None, None] == keys[6] and keys[4] == [None] * 4
    got = {r["doc_ord"]: (r["group_id"], r["certainty"], r["absorbed"]) for r in match.match(docs).collect()}
    # the order number of the document that is taken in comes first of equally common ones
    assert got == {1: ("G02", 0.4, True), 2: ("G02", 0.7, False), 3: ("G02", 0.7, False), 4: ("G01", 0.2, False), 5: ("G03", 1.0, False), 6: ("G03", 1.0, False)}


def test_spread_join_takes_counts_that_are_known(spark):
    many = spark.range(300).selectExpr("CASE WHEN id < 200 THEN 0 ELSE id END AS k", "id AS v")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    want = sorted(map(tuple, spread_join(many, one.drop("n"), ["k"], hot=50).collect()))
    assert sorted(map(tuple, spread_join(many, one, ["k"], hot=50, counted="n").collect())) == want and len(want) == 300


def test_only_what_is_voted_on_meets_the_groups(spark, monkeypatch):
    from tallymark.plans import queries

    class Seen(Exception):
        pass

    def settle_(df, name):
        if name == "members":
            raise Seen(df.columns)
        return df

    monkeypatch.setattr(queries, "settle", settle_)
    monkeypatch.setattr(queries.ma, "match", lambda docs: docs.select(F.lit("G01").alias("group_id"), "doc_ord"))
    with pytest.raises(Seen) as seen:
        queries.pipeline_summary(spark, "/root/testdata/sf0.001")
    assert set(seen.value.args[0]) == {"doc_ord", "doc_id", "identifiers", "totals", "parties", "logistics", "line_items", "group_id"}
