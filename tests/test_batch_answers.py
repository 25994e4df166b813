"""Answers of question batches with repeats, and the plan of repeat serials."""

from ticketlens import roles as R
from ticketlens.operators import questions as ask
from ticketlens.operators.repeats import repeat_serials

TICKETS = [("ABC co", "X1", "Ann", 2024, 3, 1), ("ABC co", "X2", "Ann", 2024, 3, 1), ("Zed", "X1", "Bob", 2024, 5, 2),
           ("Zed", "X1", "Bob", 2023, 1, 1), (None, "X9", None, 2024, 3, 1)]
SCHEMA = "customer string, product string, technician string, year int, month int, quarter int"


def _parsed(spark, texts):
    return ask.parse_questions(spark.createDataFrame([(t,) for t in texts], "question string"))


def test_one_answer_per_input_row(spark):
    t = spark.createDataFrame(TICKETS, SCHEMA)
    count = "gửi sản phẩm trong tháng 3 năm 2024"
    by = "Khách hàng abc gửi bao nhiêu sản phẩm trong năm 2024"
    parsed = _parsed(spark, [count] * 3 + [by] * 4)
    assert sorted(r["total"] for r in ask.ask_count(t, parsed).collect()) == [3, 3, 3]
    assert [r["total"] for r in ask.ask_count_by_customer(t, parsed).collect()] == [2] * 4
    got = sorted((r["intent"], r["total"]) for r in ask.answer_count_questions(t, parsed).collect())
    assert got == [("count_product", 3)] * 3 + [("count_product_by_customer", 2)] * 4


def test_every_intent_has_one_shape(spark):
    t = spark.createDataFrame(TICKETS, SCHEMA)
    texts = ["Sản phẩm nào nhiều nhất năm 2024", "KTV nào sửa nhiều nhất năm 2024", "Khách nào gửi nhiều nhất năm 2024",
             "Công ty ABC gửi gì nhiều", "gửi sản phẩm trong năm 2023", "Xin chào", "Xin chào"]
    out = ask.answer_questions(t, _parsed(spark, texts)).collect()
    rows = {}
    for r in out:
        rows.setdefault(r["question"], []).append((r["rank"], r["answer"], r["tickets"]))
    assert sorted(rows[texts[0]]) == [(1, "X1", 2), (2, "X2", 1), (3, "X9", 1)]
    assert rows[texts[1]] == [(1, "Ann", 2)]
    assert sorted(rows[texts[2]]) == [(1, "ABC co", 2), (2, "Zed", 1)]
    assert rows[texts[4]] == [(None, None, 1)]
    assert rows["Xin chào"] == [(None, None, None)] * 2


def test_a_batch_of_all_intents_reads_the_tickets_once(spark, tmp_path):
    path = str(tmp_path / "tickets-once")
    spark.createDataFrame(TICKETS, SCHEMA).write.parquet(path)
    t = spark.read.parquet(path)
    texts = ["Sản phẩm nào nhiều nhất năm 2024", "KTV nào sửa nhiều nhất", "Khách nào gửi nhiều nhất tháng 3 năm 2024",
             "Công ty ABC gửi gì nhiều", "gửi sản phẩm trong năm 2023"]
    out = ask.answer_questions(t, _parsed(spark, texts))
    assert out.count() >= 5
    assert "tickets-once" not in out._jdf.queryExecution().toString()      # only the written cube is read


def test_answer_cubes_equal_single_cubes(spark):
    t = spark.createDataFrame(TICKETS * 3 + [("", None, "Ann", None, None, None)], SCHEMA)
    cubes = ask.answer_cubes(t, [0, 3, 7])
    for keys, cube in cubes.items():
        want = ask.time_cube(t, keys, [0, 3, 7])
        key = lambda r: tuple(map(str, r))
        columns = [*keys, *ask.TIME, "n", "gid"]
        got = sorted((tuple(r) for r in cube.select(*columns).collect()), key=key)
        # grouping ids of a single cube have its keys in front, which are never rolled up
        assert got == sorted((tuple(r) for r in want.select(*columns).collect()), key=key)


def test_rows_of_the_top_technician(spark):
    t = spark.createDataFrame(TICKETS, SCHEMA)
    q = _parsed(spark, ["KTV nào sửa nhiều nhất năm 2024"] * 2 + ["KTV nào sửa nhiều nhất năm 1990"])
    got = sorted((r["technician"], r["product"]) for r in ask.ask_top_technician_rows(t, q, ["technician", "product"]).collect())
    assert got == [("Ann", "X1"), ("Ann", "X1"), ("Ann", "X2"), ("Ann", "X2")]


def test_a_hot_serial_is_split(spark, tmp_path):
    path = str(tmp_path / "t")
    (spark.range(400_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('s', id % 50000) END AS serial", "id")
     .repartition(8).write.parquet(path))
    keep = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("-1", "-1", "64k", "32k", "16")):
            spark.conf.set(k, v)
        out = repeat_serials(spark.read.parquet(path).withColumnRenamed("serial", R.SERIAL))
        assert len(out.collect()) == 400_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_date_ranges_prune_the_year_folders(spark, tmp_path):
    from ticketlens.operators.filters import filter_date_range, filter_sidebar
    path = str(tmp_path / "t")
    rows = spark.sql("SELECT make_timestamp_ntz(2020 + id % 4, 3, 5, 0, 0, 0) AS received_at, "
                     "CASE WHEN id <> 7 THEN CAST(2020 + id % 4 AS INT) END AS year FROM range(40)")
    rows.write.partitionBy("year").parquet(path)
    t = spark.read.parquet(path)
    for out in (filter_date_range(t, "2022-01-01", "2023-12-31"), filter_sidebar(t, start="2022-01-01", end="2023-12-31")):
        assert out.count() == 20                        # the row without a year stays
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan and "year" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_a_cube_holds_what_its_questions_ask_for(spark):
    t = spark.createDataFrame(TICKETS, SCHEMA)
    q = _parsed(spark, ["Sản phẩm nào nhiều nhất năm 2024", "gửi sản phẩm trong tháng 3 năm 2024", "Xin chào", "Công ty ABC gửi gì nhiều",
                        "Khách hàng abc gửi bao nhiêu sản phẩm trong năm 2024", "Ai gửi sản phẩm X1 nhiều", "KTV nào sửa nhiều nhất quý 1"])
    needs = ask.needed_slices(q)
    assert needs == {("product",): [3], (): [1], ("customer", "product"): [7], ("customer",): [3], ("technician",): [6]}
    cubes = ask.answer_cubes(t, [], needs)
    assert {keys: sorted({r["gid"] for r in cube.collect()}) for keys, cube in cubes.items()} == needs
    for keys, gids in needs.items():
        want = ask.time_cube(t, keys, gids).select(*cubes[keys].columns)
        assert sorted(map(str, cubes[keys].collect())) == sorted(map(str, want.collect()))


def test_fine_counts_answer_like_the_tickets(spark):
    from ticketlens.streaming.live_reports import static_count_cubes
    t = spark.createDataFrame(TICKETS * 3 + [("", None, "Ann", None, None, None)], SCHEMA)
    q = _parsed(spark, ["gửi sản phẩm trong tháng 3 năm 2024", "gửi sản phẩm trong năm 1990", "gửi sản phẩm trong quý 1",
                        "Khách hàng abc gửi bao nhiêu sản phẩm trong năm 2024", "Khách hàng z.d gửi bao nhiêu sản phẩm trong quý 2"])
    cubes = static_count_cubes(t)
    assert list(cubes) == ["fine"]              # one row per customer and periods, not one for each of 8 sets
    assert cubes["fine"].count() == t.select("customer", *ask.TIME).distinct().count()
    got, want = (sorted(map(tuple, ask.answer_count_questions(t, q, cubes=c).collect())) for c in (cubes, None))
    assert got == want and sorted(r[2] for r in got) == [0, 3, 6, 9, 12]
