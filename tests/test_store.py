"""The incremental ticket store against a full scan of the same files."""

import os
import time

from ticketlens import roles as R
from ticketlens.sources.exports import scan_tickets
from ticketlens.sources.store import Update, compact_store, ledger, read_store, update_store

HEADER = "Ngày tiếp nhận,Tên khách hàng,Sản phẩm,Nguồn file\n"


def _write(path, rows):
    path.write_text(HEADER + "".join(f"{y}-03-05 10:00:00,{c},{p},own text\n" for y, c, p in rows), "utf-8")


def _rows(df):
    return sorted((tuple(r) for r in df.select(R.YEAR, R.CUSTOMER, R.PRODUCT).collect()), key=str)


def _files(store):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(os.path.join(store, "rows")) for f in fs if f.endswith(".parquet")}


def test_an_update_reads_and_writes_only_what_changed(spark, tmp_path):
    drops, store = tmp_path / "drops", str(tmp_path / "store")
    drops.mkdir()
    assert update_store(spark, store, str(drops)) == Update(0, 0, 0, 0)
    assert read_store(spark, store).collect() == []
    _write(drops / "a b+c%1.csv", [(2021, "A", i) for i in range(50)])
    _write(drops / "two.csv", [(2022, "B", i) for i in range(40)])
    (drops / "blank.csv").write_text("\n", "utf-8")
    assert update_store(spark, store, str(drops)) == Update(3, 0, 0, 0)
    assert _rows(read_store(spark, store)) == _rows(scan_tickets(spark, str(drops)))
    first = _files(store)
    assert update_store(spark, store, str(drops)) == Update(0, 0, 0, 3) and _files(store) == first

    # a second drop: its own rows only
    _write(drops / "three.csv", [(2021, "C", 1), (None, "C", 2)])
    assert update_store(spark, store, str(drops)) == Update(1, 0, 0, 3)
    second = _files(store)
    assert first.items() < second.items()
    assert _rows(read_store(spark, store)) == _rows(scan_tickets(spark, str(drops)))

    # a file changes, another goes
    time.sleep(0.01)
    _write(drops / "a b+c%1.csv", [(2023, "A2", 7)])
    (drops / "two.csv").unlink()
    assert update_store(spark, store, str(drops)) == Update(0, 1, 1, 2)
    assert second.items() < _files(store).items()
    want = _rows(scan_tickets(spark, str(drops)))
    assert _rows(read_store(spark, store)) == want and len(want) == 3
    pruned = read_store(spark, store, [R.CUSTOMER, R.YEAR]).where(f"{R.YEAR} = 2023")
    assert [tuple(r) for r in pruned.collect()] == [("A2", 2023)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert R.YEAR in plan.split("PartitionFilters:")[1].split("]")[0] and R.PRODUCT not in plan.split("ReadSchema:")[1].split(">")[0]

    compact_store(spark, store)
    assert _rows(read_store(spark, store)) == want
    assert len({r["batch"] for r in ledger(spark, store).collect()}) == 1
    assert update_store(spark, store, str(drops)) == Update(0, 0, 0, 3)
    assert "Anti" not in read_store(spark, store)._jdf.queryExecution().toString()


def test_a_half_written_version_is_not_seen(spark, tmp_path):
    drops, store = tmp_path / "drops", tmp_path / "store"
    drops.mkdir()
    _write(drops / "one.csv", [(2021, "A", 1)])
    update_store(spark, str(store), str(drops))
    (store / "ledger" / "v=2").mkdir()                 # an update that died
    (store / "rows" / "batch=dead").mkdir()
    assert len(read_store(spark, str(store)).collect()) == 1
    _write(drops / "two.csv", [(2021, "B", 1)])
    assert update_store(spark, str(store), str(drops)) == Update(1, 0, 0, 1)
    assert len(read_store(spark, str(store)).collect()) == 2
