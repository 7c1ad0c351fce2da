import datetime

from pyspark.sql import functions as F

from clausewise.operators import resolution

D1, D2, D3 = (datetime.date(2026, m, 1) for m in (1, 2, 3))
BASE = [("f", "I", 0, "Agreement"), ("f", "I.A", 1, "alpha"), ("f", "I.A.1", 2, "one"), ("f", "I.B", 3, "beta"), ("f", "II", 4, "Definitions")]


def op(op_id, amendment, kind, path, text=None, effective=D1, ord=0, op_no=0, **more):
    row = dict(account="a", op_id=op_id, amendment=amendment, form=f"F{amendment}", effective=effective, ord=ord, op_no=op_no, kind=kind, path=path, text=text, label=None, fragments=None, status="resolved", schedule_key=None, values=None)
    row.update(more)
    return tuple(row[c.split()[0]] for c in "account op_id amendment form effective ord op_no kind path text label fragments status schedule_key values".split())


def run(spark, ops, at=D2):
    base = spark.createDataFrame(BASE, "base_form string, path string, ordinal int, text string")
    got = resolution.resolve(spark.createDataFrame(ops, resolution.OPS), base, F.lit(at))
    return base, got, {r.path: r for r in got.changed.collect()}


def test_order_dates_and_conflicts(spark):
    ops = [
        op("1", "x", "REPLACE", "I.A", "from x", ord=0),
        op("2", "y", "REPLACE", "I.A", "from y", ord=1),
        op("3", "z", "REPLACE", "I.A", "too late", effective=D3),
        op("4", "x", "DELETE", "I.B", ord=0, op_no=1),
        op("5", "y", "REPLACE", "I.B", "back", effective=D2),
        op("6", "y", "AMEND_DEF", "II", "more", effective=None),
        op("7", "y", "DELETE", "no.such"),
        op("8", "y", "ADD", None, "floating", status="unresolved"),
        op("9", "y", "REPLACE", "I", "held", status="held"),
    ]
    _, got, rows = run(spark, ops)
    assert rows["I.A"].text == "from y" and rows["I.A"].active
    assert [(c.earlier, c.later, c.before, c.after) for c in rows["I.A"].conflicts] == [("1", "2", "from x", "from y")]
    assert (rows["I.B"].text, rows["I.B"].active, rows["I.B"].conflicts) == ("back", True, [])
    assert rows["II"].text == "Definitions more"
    assert rows["UNRESOLVED.y.1"].text == "floating" and rows["UNRESOLVED.y.1"].parent is None
    assert set(rows) == {"I.A", "I.B", "II", "UNRESOLVED.y.1"}
    assert {r.op_id for r in got.held.collect()} == {"9"}
    assert {r.op_id for r in got.unresolved.collect()} == {"7", "8"}


def test_schedule_and_restated_fragments(spark):
    ops = [
        op("1", "x", "REPLACE", "I.A", "limit ____ of $____ paid", status="held", schedule_key="k", values={"j": "no", "k": r"$5\1"}),
        op("2", "x", "REPLACE", "I.A.1", "all", op_no=1, fragments=[(["A"], "zero"), (["1"], "uno"), (["1", "a"], "sub"), (["2"], "due")]),
    ]
    _, _, rows = run(spark, ops)
    assert rows["I.A"].text == r"limit $5\1 of $ paid"
    assert rows["I.A.1"].text == "uno a sub"


def test_additions_and_order(spark):
    ops = [
        op("1", "x", "ADD", "I.A", None, label="9", fragments=[(["A"], "crumb"), (["9"], "nine"), ([], "goes on"), (["9", "a"], "below")]),
        op("2", "y", "ADD", "I.A", "other nine", label="9", effective=D2),
        op("3", "y", "ADD", "I", "clash", label="B", op_no=1),
        op("4", "y", "ADD", "II", "bare", op_no=2),
        op("5", "z", "DELETE", "I.A.9", effective=D2),
    ]
    base, got, rows = run(spark, ops)
    assert rows["I.A.9"].text == "nine goes on" and not rows["I.A.9"].active and rows["I.A.9"].added_by == "x"
    assert rows["I.A.9.a"].text == "below" and rows["I.A.9+Fy"].text == "other nine"
    assert rows["I.B+Fy"].text == "clash" and rows["II.+"].text == "bare"
    assert got.unresolved.count() == 0
    accounts = spark.createDataFrame([("a", "f"), ("b", "f")], "account string, base_form string")
    whole = resolution.materialise(base, accounts, got.changed).orderBy(F.asc_nulls_last("anchor"), "added", "born", "pos")
    assert [r.path for r in whole.where("account = 'a'").collect()] == ["I", "I.A", "I.A.1", "I.A.9", "I.A.9.a", "I.A.9+Fy", "I.B", "I.B+Fy", "II", "II.+"]
    assert [r.path for r in whole.where("account = 'b'").collect()] == [b[1] for b in BASE]


def test_empty(spark):
    _, got, rows = run(spark, [])
    assert rows == {} and got.held.count() == got.unresolved.count() == 0
