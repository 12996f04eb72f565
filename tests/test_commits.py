"""Tables that are always there, and numbers taken once."""

import datetime as dt
import threading

import pytest

from plumbline import OperatorError, Pickup, RowCount, read_table, write_table
from plumbline.operators.ledger import Ledger
from plumbline.sources import commits as C
from plumbline.sources.files import materialise


def numbers(spark, n, value):
    return spark.range(n).selectExpr("id", f"{value} as v")


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write_table(numbers(spark, 10, 1), path, commits=True)
    write_table(read_table(spark, path).selectExpr("id", "v + 1 as v"), path)  # over itself
    assert C.versions(spark, path) == [1, 2] and {r.v for r in read_table(spark, path).collect()} == {2}
    assert {r.v for r in C.read_committed(spark, path, 1).collect()} == {1}
    old = read_table(spark, path)
    for v in range(3, 6):
        write_table(numbers(spark, 10, v), path)
    assert {r.v for r in old.collect()} == {2}  # (a reader that has begun goes on)
    assert C.drop_versions(spark, path, keep=2) == 3 and C.versions(spark, path) == [4, 5]
    assert {r.v for r in read_table(spark, path).collect()} == {5}
    with pytest.raises(OperatorError, match="no version 1"):
        C.read_committed(spark, path, 1)
    with pytest.raises(OperatorError, match="no longer the latest"):
        C.commit_table(numbers(spark, 1, 9), path, expected=4)
    assert C.commit_table(numbers(spark, 1, 9), path, expected=5) == 6
    with pytest.raises(OperatorError):
        C.read_committed(spark, str(tmp_path))
    plain = str(tmp_path / "plain.parquet")
    write_table(numbers(spark, 3, 1), plain)
    with pytest.raises(OperatorError, match="no committed table"):
        write_table(numbers(spark, 3, 2), plain, commits=True)
    assert materialise(numbers(spark, 3, 4), str(tmp_path / "m")).count() == 3 and materialise(numbers(spark, 5, 4), str(tmp_path / "m")).count() == 5


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    write_table(numbers(spark, 10, 1), path, commits=True)
    with monkeypatch.context() as broken:
        broken.setattr(C, "claim", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            write_table(numbers(spark, 10, 2), path)
    with pytest.raises(Exception, match="broken row"):
        write_table(numbers(spark, 10, 2).selectExpr("id", "if(id = 7, raise_error('broken row'), v) as v"), path)
    assert {r.v for r in read_table(spark, path).collect()} == {1} and C.versions(spark, path) == [1]
    assert len(list((tmp_path / "t.parquet" / "_data").iterdir())) >= 2
    C.drop_versions(spark, path, left_before=dt.datetime.now() + dt.timedelta(minutes=1))
    assert len(list((tmp_path / "t.parquet" / "_data").iterdir())) == 1 and read_table(spark, path).count() == 10


def test_readers_always_find_a_table(spark, tmp_path):
    path, found, wrong = str(tmp_path / "t.parquet"), [], []
    write_table(numbers(spark, 200, 0), path, commits=True)
    done = threading.Event()

    def read():
        while not done.is_set():
            try:
                rows = read_table(spark, path).groupBy("v").count().collect()
                found.append(rows[0].v)
                if len(rows) != 1 or rows[0]["count"] != 200:
                    wrong.append(rows)
            except Exception as e:
                wrong.append(e)

    readers = [threading.Thread(target=read) for _ in range(2)]
    [r.start() for r in readers]
    for v in range(1, 9):
        write_table(numbers(spark, 200, v), path)
    done.set()
    [r.join() for r in readers]
    assert not wrong and len(found) > 2


def test_writers_at_the_same_time(spark, tmp_path):
    path, made = str(tmp_path / "t.parquet"), []
    writers = [threading.Thread(target=lambda v=v: made.append(C.commit_table(numbers(spark, 10, v), path))) for v in range(6)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(made) == C.versions(spark, path) == [1, 2, 3, 4, 5, 6] and read_table(spark, path).count() == 10


def test_one_of_many_claims(spark, tmp_path):
    won = []
    claims = [threading.Thread(target=lambda i=i: won.append((i, C.claim(spark, f"{tmp_path}/a b/1", str(i))))) for i in range(12)]
    [c.start() for c in claims]
    [c.join() for c in claims]
    [winner] = [i for i, ok in won if ok]
    assert C.read_text(spark, f"{tmp_path}/a b/1") == str(winner) and C.read_text(spark, f"{tmp_path}/a b/2") is None


def test_run_numbers_of_pickups_at_the_same_time(spark, tmp_path):
    ledger, given = Ledger(spark, str(tmp_path / "ledger")), []
    ledger.append("runs", [{"run_id": 6, "flow": "f", "flow_path": "f", "params": "old", "status": "success", "seq": 0}])
    assert ledger.run_number("f", "old") == 6
    asks = [threading.Thread(target=lambda i=i: given.append((i % 8, ledger.run_number("f", f"batch {i % 8}")))) for i in range(16)]
    [a.start() for a in asks]
    [a.join() for a in asks]
    by_batch = {}
    for batch, number in given:
        by_batch.setdefault(batch, set()).add(number)
    assert all(len(numbers) == 1 for numbers in by_batch.values()) and len({n for s in by_batch.values() for n in s}) == 8
    assert min(n for s in by_batch.values() for n in s) >= 7

    def pick(name):
        for part in range(2):
            numbers(spark, 4, part).write.mode("append").parquet(str(tmp_path / name / "in"))
            Pickup(spark, str(tmp_path / name / "in"), "id long, v int", str(tmp_path / name / "checkpoint"), [RowCount(at_least=1)],
                   str(tmp_path / name / "out"), ledger=ledger, flow=name).run()

    both = [threading.Thread(target=pick, args=(name,)) for name in ("one", "two")]
    [b.start() for b in both]
    [b.join() for b in both]
    runs = [r.run_id for r in ledger.events("runs").where("started_by = 'pickup'").collect()]
    assert len(runs) >= 4 and len(runs) == len(set(runs))
