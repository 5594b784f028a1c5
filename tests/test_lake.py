import pytest

from tidepool.sources.lake import Lake, read_csv


def test_cells(tiny):
    cells = {(r.table_id, r.colid, r.rowid): (r.token, r.quadrant) for r in tiny.by_token().collect()}
    assert cells[0, 0, 0] == ("foo", None)
    assert [cells[0, 1, i][1] for i in range(3)] == [False, True, False]  # a missing number is in the lower quadrant
    assert cells[0, 1, 2][0] == "" and cells[2, 0, 4][0] == "" and cells[2, 1, 4][0] == ""
    assert len(cells) == 3 * 2 + 2 * 2 + 5 * 2 + 12 * 3
    assert tiny.copies_agree()


def test_registry_and_table(tiny):
    reg = [(r.global_id, r.table_id, r.colid, r["column"], r.n_rows) for r in tiny.columns().orderBy("global_id").collect()]
    assert reg[0] == (0, 0, 0, "a", 3) and reg[-1] == (8, 3, 2, "v", 12)
    assert [tuple(r) for r in tiny.table(1).orderBy("rowid").collect()] == [(0, "foo", "10"), (1, "baz", "20")]


def test_csv_lake(spark, tmp_path):
    d = tmp_path / "csvs"
    d.mkdir()
    (d / "b.csv").write_text("n,s\n1,x\nNA,y\n3,NULL\n")
    (d / "a.csv").write_text('s\n"q, 1"\n"two\nlines"\n')
    (d / "._a.csv").write_text("junk\n")
    lake = Lake.from_csv(spark, str(d), str(tmp_path / "root"))
    assert lake.names == ["a.csv", "b.csv"]
    assert dict(lake.frames["b.csv"].dtypes) == {"n": "bigint", "s": "string"}
    got = {(r.table_id, r.colid, r.rowid): (r.token, r.quadrant) for r in lake.by_row().collect()}
    assert got[0, 0, 1] == ("twolines", None) and got[1, 0, 1] == ("", False) and got[1, 0, 2] == ("3", True) and got[1, 1, 2] == ("", None)
    assert read_csv(spark, str(d / "b.csv"), strings=True).collect()[1].n == "NA"
    with pytest.raises(FileNotFoundError):
        Lake.from_csv(spark, str(tmp_path))


def test_resume(spark, tmp_path):
    root = str(tmp_path / "lake")
    a, b = spark.createDataFrame([("x",)], "c string"), spark.createDataFrame([("y",)], "c string")
    lake = Lake(spark, {"a": a, "b": b}, root).build()
    again = Lake(spark, {"a": a, "b": b}, root).build(resume=True)
    assert again.by_token().count() == lake.by_token().count() == 2
    with pytest.raises(ValueError):
        Lake(spark, {"a": a, "z": b}, root).build(resume=True)


def test_resume_after_a_failure(spark, tmp_path, monkeypatch):
    """A run that breaks between the copies of its third group leaves two groups, and the next run ends it."""
    frames = {n: spark.createDataFrame([(f"{n}{i}", i) for i in range(5)], "c string, x int") for n in "abcd"}
    root, write, count = str(tmp_path / "lake"), Lake._write_by_token, []

    def broken(self, cells, folder):
        count.append(folder)
        if len(count) == 3:
            raise RuntimeError("lost")
        write(self, cells, folder)

    monkeypatch.setattr(Lake, "_write_by_token", broken)
    with pytest.raises(RuntimeError):
        Lake(spark, frames, root).build(group_cells=1)
    assert Lake(spark, frames, root)._loaded() == {0, 1}
    lake = Lake(spark, frames, root).build(resume=True, group_cells=1)
    assert len(count) == 5 and count[2] == count[3]  # the broken group again, then the last; the others were kept
    assert lake.copies_agree() and lake.by_token().count() == lake.by_row().count() == 40
    assert Lake(spark, frames, root).by_row().groupBy("table_id").count().count() == 4


def test_row_numbers_over_files(spark, tmp_path):
    p = str(tmp_path / "many")
    spark.range(0, 100, 1, 4).selectExpr("cast(id as string) as v").write.parquet(p)
    lake = Lake(spark, {"t": spark.read.parquet(p)}, str(tmp_path / "root"))
    assert sorted(r.rowid for r in lake.explode("t").collect()) == list(range(100))


def test_readers(spark, tmp_path):
    from tidepool.sources import readers

    (tmp_path / "gt.csv").write_text("query_table,candidate_table\na,b\na,a\na,c\na,b\n")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [tuple(r) for r in readers.ground_truth(spark, str(tmp_path / "gt.csv"), names).select("query_table", "candidate_table").collect()] == [("a", "b")]
    (tmp_path / "w.json").write_text('{"relation": [["h", "1"], ["g", "2"]]}\n')
    assert readers.relation_chunks(spark, str(tmp_path / "w.json")).count() == 4
    log = readers.RunLog(spark, str(tmp_path / "log"), "name string, seconds double")
    assert log.read().count() == 0
    log.log(("a", 1.0), ("b", 3.0))
    assert log.averages().first().seconds == 2.0
    readers.write_run(spark, str(tmp_path / "run"), {"k": 1}, names, names)
    assert readers.storage_audit(spark, str(tmp_path / "run")).count() == 4
    assert readers.slug("a b/c") == "a-b-c"


def test_the_index_shuffles_no_cells(spark, tmp_path, monkeypatch):
    """Both copies are written from rows that were dealt out before they became cells; more cells, more parts."""
    from tidepool.sources import lake as module

    plans, write = [], Lake._write_by_token
    monkeypatch.setattr(module, "CELLS_PER_PARTITION", 100)
    monkeypatch.setattr(Lake, "_write_by_token", lambda self, cells, folder: (plans.append(cells._jdf.queryExecution().executedPlan().toString()), write(self, cells, folder))[1])
    frame = spark.createDataFrame([(f"w{i % 7}", i) for i in range(1000)], "c string, x int")
    lake = Lake(spark, {"a": frame}, str(tmp_path / "lake"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lake.build()
    assert plans and "Exchange" not in plans[0] and spark.conf.get("spark.sql.files.maxPartitionBytes") == size
    assert lake.by_row().count() == 2000 and lake.copies_agree()
    assert len(list((tmp_path / "lake" / "by_row").rglob("*.parquet"))) >= 20
    assert [r.rowid for r in lake.by_token().where("token = 'w3'").orderBy("rowid").collect()] == [i for i in range(1000) if i % 7 == 3]


def test_searches_write_no_more_of_the_index_than_they_read(spark, tmp_path):
    """First rows, whole scans, the first searches by values and row matches write no copy; a copy is written alone."""
    from tidepool.operators import profiling, seekers
    from tidepool.operators.filters import IdFilter
    from tidepool.sources import lake as module

    root = tmp_path / "lake"
    a = spark.createDataFrame([(i, f"w{i % 7}", float(i)) for i in range(60)], "k int, c string, x double")
    lake = Lake(spark, {"a": a, "b": a.limit(5)}, str(root))
    wrote = lambda: {c for c in ("by_row", "by_token") if (root / c).exists()}
    assert seekers.correlation(lake, a.select("k", "x")).count() > 0
    assert profiling.key_value_pairs(lake.first_rows(5000)).count() == 1
    assert profiling.keywords(lake.cells(), 3).count() == 3 and lake.cells([1]).count() == 15
    assert seekers.matching(lake, ["w1"], IdFilter.of(allow=[])).count() == 0
    found = {r.table_id: r.score for r in seekers.multi_column(lake, [("w1", "1"), ("w2", "2")]).collect()}
    assert found == {0: 2, 1: 2} and wrote() == set()
    for _ in range(module.PLAIN_READS):
        assert seekers.matching(lake, ["w1"]).count() == 10
    assert wrote() == {"by_token"} and not lake.has("by_row") and lake.cells().count() == 195
    assert lake.by_row().count() == 195 and lake.copies_agree()


def test_index_parity_reads_each_copy_once(spark, tiny, monkeypatch):
    """The copies are compared by what is summed anyway; a difference is an error."""
    from tidepool import queries

    monkeypatch.setattr(queries, "lake", lambda s, d: tiny)
    monkeypatch.setattr(Lake, "copies_agree", lambda self: pytest.fail("read again"))
    assert queries.index_parity(spark, "").count() == 8
    cells = tiny.by_token()
    monkeypatch.setattr(Lake, "by_token", lambda self: cells.where("rowid < 3"))
    with pytest.raises(ValueError):
        queries.index_parity(spark, "")
