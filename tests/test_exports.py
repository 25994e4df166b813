"""Ragged ticket exports (FIXTURES.md §1): accents or not, aliases, column
order, outer spaces, a missing column, day-first dates."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from ticketlens import roles as R
from ticketlens.session import scratch_path
from ticketlens.sources.exports import layouts_of, resolve_headers, scan_tickets, snake_headers

ROWS = [
    ("2024-03-05 10:00:00", "Công ty A", "May in X", "1", "", "0", "S1"),
    ("2024-07-01 00:00:00", "Cty B", "May in Y", "0", "1.0", "", "S1"),
    ("not a date", None, "May in X", "x", "0", "1", None),
]


def _write(spark, header, rows, name):
    path = scratch_path(spark, name + uuid.uuid4().hex[:4])
    spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header)) \
        .coalesce(1).write.option("header", True).csv(path)
    return path


def test_unaccented_and_alias_headers_resolve():
    got = resolve_headers(["Ngay tiep nhan", "Ten khach hang", "San pham", "Da sua xong",
                           "Khong sua duoc", "Tu choi bao hanh", "Serial"])
    assert set(got) >= {R.RECEIVED_AT, R.CUSTOMER, R.PRODUCT, R.IS_DONE, R.IS_FAILED,
                        R.IS_REJECTED, R.SERIAL}
    # a header is given to one role only
    assert len(set(got.values())) == len(got)


def test_ragged_layouts_union_by_role(spark):
    a = _write(spark, ["Ngày tiếp nhận", "Tên khách hàng", "Sản phẩm", "Đã sửa xong",
                       "Không sửa được", "Từ chối bảo hành", "Serial"], ROWS, "a")
    # other order, unaccented / alias headers with outer spaces, no serial, day-first dates
    rows_b = [("05/03/2024", "Cty C", "May in Z", "1", "0", "0")]
    b = _write(spark, [" Tu choi bh ", "Ngay nhan", " Cty", "Ma hang", "Hoan tat", "That bai"],
               [(r[5], r[0], r[1], r[2], r[3], r[4]) for r in rows_b], "b")
    name = F.regexp_extract(R.SOURCE_FILE, r"/([ab])[0-9a-f]{4}-[0-9a-f]+/", 1)
    all_rows = scan_tickets(spark, [a, b]).withColumn(R.SOURCE_FILE, name).collect()
    assert len(all_rows) == 4
    rows = {(r[R.SOURCE_FILE], r[R.PRODUCT]): r for r in all_rows if r[R.RECEIVED_AT] is not None}
    first = rows[("a", "May in X")]
    assert first[R.RECEIVED_AT] == dt.datetime(2024, 3, 5, 10, 0)
    assert (first[R.YEAR], first[R.MONTH], first[R.QUARTER]) == (2024, 3, 1)
    y = rows[("a", "May in Y")]
    assert (y[R.IS_DONE], y[R.IS_FAILED], y[R.IS_REJECTED]) == (0, 1, None)
    c = rows[("b", "May in Z")]
    assert c[R.RECEIVED_AT] == dt.datetime(2024, 3, 5) and c[R.CUSTOMER] == "Cty C"
    assert c[R.SERIAL] is None and c[R.IS_DONE] == 1
    # an unparseable date and a non-numeric flag become NULL
    bad = [r for r in all_rows if r[R.SOURCE_FILE] == "a" and r[R.RECEIVED_AT] is None]
    assert len(bad) == 1 and bad[0][R.IS_DONE] is None and bad[0][R.YEAR] is None


def test_aliases_count_in_alias_order():
    # "khach hang" comes before "ten kh" among the aliases, whatever the file order
    assert resolve_headers(["ten kh", "khach hang"])[R.CUSTOMER] == "khach hang"
    assert resolve_headers(["ngay gui", "Ngay nhan"])[R.RECEIVED_AT] == "Ngay nhan"


def test_one_folder_with_swapped_layouts_and_awkward_cells(spark, tmp_path):
    (tmp_path / "one.csv").write_text(
        'Tên khách hàng,Sản phẩm,Đã sửa xong\n"ACME ""North"", Ltd","line one\nline two",1\nZeta,P,1.9\n', "utf-8")
    (tmp_path / "two.csv").write_text("\ufeffSan pham, Cty ,Da sua xong\nQ,Zeta,1.0\nR,,\n", "utf-8")
    (tmp_path / "empty.csv").write_text("", "utf-8")
    rows = scan_tickets(spark, str(tmp_path)).collect()
    got = sorted(((r[R.CUSTOMER], r[R.PRODUCT], r[R.IS_DONE]) for r in rows), key=str)
    assert got == sorted([('ACME "North", Ltd', "line one\nline two", 1), ("Zeta", "P", None),
                          ("Zeta", "Q", 1), (None, "R", None)], key=str)


def test_empty_report_leaves_nothing_and_context_is_csv(spark, tmp_path):
    from ticketlens.sources.sinks import context_extract, context_text, write_report
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2), 'a "b", c', None)],
                               "received_at timestamp_ntz, customer string, serial string")
    assert write_report(df, str(tmp_path / "full"), "csv") and (tmp_path / "full").exists()
    assert not write_report(df.where("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    lines = context_extract(df, ["received_at"])
    assert lines.first()["line"] == '2024-01-02 00:00:00,"a ""b"", c",'
    assert context_text(lines, df.columns).first()["csv"].split("\n")[0] == "ngay_tiep_nhan,ten_khach_hang,serial"


def test_ticket_store_follows_its_inputs(spark, tmp_path):
    import shutil

    from locations import SF_SMALL
    from ticketlens.sources.testdata import ingest_tickets, store_path, tickets
    sf = tmp_path / "sf"
    sf.mkdir()
    for name in ("lineitem", "orders", "customer", "part", "supplier"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", sf)
    planned = tickets(spark, str(sf), [R.PRODUCT])
    assert "tickets-" not in planned._jdf.queryExecution().toString()
    path = ingest_tickets(spark, str(sf))
    assert path == store_path(spark, str(sf)) == ingest_tickets(spark, str(sf))
    stored = tickets(spark, str(sf))
    assert "tickets-" in stored._jdf.queryExecution().toString()
    assert stored.count() == planned.count()
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(7).coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    (sf / "lineitem.parquet").unlink()
    shutil.copytree(tmp_path / "x", sf / "lineitem.parquet")
    assert store_path(spark, str(sf)) != path
    assert tickets(spark, str(sf)).count() == 7


def test_snake_headers(spark):
    df = spark.createDataFrame([(1, 2)], "`Đã sửa xong` int, `Tên lỗi (Báo lỗi)` int")
    assert snake_headers(df).columns == ["đa_sua_xong", "ten_loi_bao_loi"]


def _export(path, rows, cell=lambda i: f"Cty {i}"):
    path.write_text("Tên khách hàng,Sản phẩm,Đã sửa xong\n" + "".join(f"{cell(i)},May {i % 7},{i % 2}\n" for i in range(rows)), "utf-8")


def test_one_large_file_is_read_in_several_tasks(spark, tmp_path):
    _export(tmp_path / "plain.csv", 20_000, lambda i: f'"Cty ""{i}"", Ltd"')
    _export(tmp_path / "broken.csv", 300, lambda i: f'"Cty\nsố {i}"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        layouts = layouts_of(spark, [str(tmp_path)])
        (layout,) = layouts.values()
        assert [f.rsplit("/", 1)[1] for f in layout.plain + layout.quoted] == ["plain.csv", "broken.csv"]
        plain = scan_tickets(spark, str(tmp_path / "plain.csv"))
        assert plain.rdd.getNumPartitions() > 5
        got = plain.groupBy(R.CUSTOMER).count().collect()
        assert len(got) == 20_000 and {r[R.CUSTOMER] for r in got} == {f'Cty "{i}", Ltd' for i in range(20_000)}
        broken = scan_tickets(spark, str(tmp_path / "broken.csv"))
        assert {r[R.CUSTOMER] for r in broken.collect()} == {f"Cty\nsố {i}" for i in range(300)}
        assert scan_tickets(spark, str(tmp_path)).count() == 20_300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_records_of_any_length_and_over_several_lines(spark, tmp_path):
    filler = [f"cột thừa {i} " + "x" * 1000 for i in range(100)]
    (tmp_path / "long header.csv").write_text(",".join([*filler, "Serial", "Sản phẩm"]) + "\n" + "," * 100 + "S1,P\n", "utf-8")
    (tmp_path / "two lines.csv").write_text('\n"Ghi\nchú ""a""\nvà b",Serial,"Sản phẩm"\n"x\ny",S2,Q\n,S3,"Q, R"\n', "utf-8")
    (tmp_path / "blank.csv").write_text("\n \n", "utf-8")
    headers = {h: (len(x.plain), len(x.quoted)) for h, x in layouts_of(spark, [str(tmp_path)]).items()}
    assert headers == {(*filler, "Serial", "Sản phẩm"): (1, 0), ('Ghi\nchú "a"\nvà b', "Serial", "Sản phẩm"): (0, 1)}
    rows = scan_tickets(spark, str(tmp_path)).collect()
    assert {(r[R.SERIAL], r[R.PRODUCT]) for r in rows} == {("S1", "P"), ("S2", "Q"), ("S3", "Q, R")}


def test_a_folder_without_records(spark, tmp_path):
    (tmp_path / "blank.csv").write_text("\n\n", "utf-8")
    with pytest.raises(FileNotFoundError):
        scan_tickets(spark, str(tmp_path))


def test_a_compressed_export_is_scanned_like_a_plain_one(spark, tmp_path):
    from ticketlens.sources import exports, sinks
    rows = [('A "b", c\nd', "X1"), ("plain", "X2"), (None, "X3")]
    t = spark.createDataFrame(rows, "customer string, product string")
    path = sinks.write_export(t, str(tmp_path / "zipped"), exports.EXPORT_HEADERS, compression="gzip")
    assert list((tmp_path / "zipped").glob("*.csv.gz")) and not list((tmp_path / "zipped").glob("*.csv"))
    got = {(r["customer"], r["product"]) for r in exports.scan_tickets(spark, path).collect()}
    assert got == set(rows)
