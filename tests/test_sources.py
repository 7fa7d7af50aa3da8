import json

from granary import cli
from granary.sources import files, log_source, packs
from granary.streaming.refresh import current, follow, windowed_counts


def test_csv_in(spark, tmp_path):
    (tmp_path / "a.csv").write_text('part_no,name,qty,price,zip\nA1,"Hex, bolt",10,0.50,007\n\nB2,=cmd,,1,010\n')
    df = files.typed(files.read_csv(spark, str(tmp_path / "a.csv")))
    assert dict(df.dtypes) == {"part_no": "string", "name": "string", "qty": "bigint", "price": "double", "zip": "string"}
    assert [tuple(r) for r in df.collect()] == [("A1", "Hex, bolt", 10, 0.5, "007"), ("B2", "=cmd", None, 1.0, "010")]
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2,5\n")
    assert files.read_csv(spark, str(tmp_path / "b.tsv")).first() == ("1", "2,5")


def test_formulas_are_guarded(spark):
    df = spark.createDataFrame([(x,) for x in ["=1", "@a", "-5", "-5a", "+", "+x", "\tz", "a", None, "-1e3"]], "c string")
    assert [r.c for r in files.csv_rows(df).collect()] == ["'=1", "'@a", "-5", "'-5a", "+", "'+x", "'\tz", "a", None, "-1e3"]


def test_json_and_html_out(spark):
    df = files.from_table(spark, ["a", "b"], [[1, "<x>"], [2]])
    assert [json.loads(r.json) for r in files.json_rows(df).collect()] == [{"a": 1, "b": "<x>"}, {"a": 2, "b": None}]
    text = "\n".join(files.html_table(df, "note -- here"))
    assert "<td>&lt;x&gt;</td>" in text and "<!-- note — here -->" in text


def test_packs(spark):
    p = packs.encode(["id", "v"], [["a", 1], ["b", 2]], deleted=(1,))
    df = spark.createDataFrame([("1", p), ("2", "junk"), ("3", packs.TAG + "j{"), ("4", packs.TAG + 's{"pk":"id"}'), ("5", None)], "id string, p string")
    got = [(r.id, r.key, r["values"], r.deleted) for r in packs.decode(df).orderBy("id", "record").collect()]
    assert got == [("1", "a", {"id": "a", "v": "1"}, False), ("1", "b", {"id": "b", "v": None}, True)]
    assert [r.structure for r in packs.structures(df).collect()] == ['{"pk":"id"}']


def test_packs_fit_their_bound():
    rows = [[f"k{i}", "é" * (i % 40)] for i in range(200)]
    held = packs.plan(["id", "v"], rows, 500)
    assert all(len(p.encode()) <= 500 for p in held)
    assert [r for p in held for r in json.loads(p[len(packs.TAG) + 1 :])["r"]] == rows


def test_packs_are_counted_and_cross_batches(spark):
    df = spark.createDataFrame([(f"k{i}", "x],[y" * (i % 3)) for i in range(500)], "id string, v string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        held = packs.write_packs(df, "id", 3000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.p for r in held] == packs.plan(["id", "v"], [list(r) for r in df.collect()], 3000), "batches don't cut packs"
    assert [r.n_records for r in held] == [len(json.loads(r.p[len(packs.TAG) + 1 :])["r"]) for r in held] and sum(r.n_records for r in held) == 500


def test_foreign_packs(spark):
    df = spark.createDataFrame([("ZZ1:a,b",), ("other",)], "p string")
    read = {"ZZ1": lambda p: [{"v": x} for x in p[4:].split(",")]}
    assert [r.v for r in packs.decode_with(df, read, "v string").collect()] == ["a", "b"]


def test_log_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps({"id": str(k), "p": "x", "signer": "s", "time": k}) + "\nnot json\n")
    log_source.register(spark)
    held = spark.read.format("granary_log").option("path", str(tmp_path))
    assert sorted(r.id for r in held.load().collect()) == ["0", "1", "2"]
    assert sorted(r.id for r in held.option("maxPages", "2").load().collect()) == ["1", "2"]
    uri = spark.read.format("granary_log").option("path", tmp_path.as_uri()).option("after", "1.jsonl")
    assert [tuple(r) for r in uri.load().collect()] == [("2", "x", "s", 2)]


def test_odd_lines_of_a_log(spark, tmp_path):
    lines = ['{"id": 7, "p": null, "time": 99999999999999999999}', "[1]", "", '{"p": {"a": 1}, "time": true, "more": 0}']
    (tmp_path / "0.jsonl").write_text("\n".join(lines))
    (tmp_path / "1.jsonl").write_text("")
    log_source.register(spark)
    got = spark.read.format("granary_log").option("path", str(tmp_path)).load().collect()
    assert [tuple(r) for r in got] == [("7", None, None, None), (None, '{"a": 1}', None, None)]


def test_follow_a_log(spark, tmp_path):
    source, target, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    for k, lines in enumerate([[("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")]]):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"key": a, "seq": b, "v": c}) for a, b, c in lines))
        follow(spark, str(source), target, "key string, seq long, v string", "key", "seq", marks).awaitTermination()
    assert sorted((r.key, r.v) for r in current(spark, target).collect()) == [("a", "z"), ("b", "y")]


def test_windowed_counts(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2026-01-01 00:00:10', 'a'), (TIMESTAMP'2026-01-01 00:04:59', 'a'), (TIMESTAMP'2026-01-01 00:05:00', 'a') AS t(ts, k)")
    assert sorted(r.n for r in windowed_counts(df, "ts", "5 minutes", "1 minute", "k").collect()) == [1, 2]


def test_cli(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sku,qty\nA,1\nB,=2\nB,3\n")
    held = cli.encode(spark, str(tmp_path / "a.csv"))
    assert (held["rows"], held["duplicate_keys"], len(held["packs"])) == (3, 1, 1)
    assert cli.decode(spark, held["packs"]) == "sku,qty\nA,1\nB,'=2\nB,3\n"
    out = cli.run_sql(spark, "SELECT sku, sku FROM t WHERE id = 1; SET @x = 1", {"t": str(tmp_path / "a.csv")}, "json")
    assert out == '[{"sku": "A", "sku_2": "A"}]Set\n'
    log = tmp_path / "log"
    log.mkdir()
    (log / "0.json").write_text("\n".join(json.dumps({"id": str(k), "p": packs.encode(["id", "v"], rows, deleted=gone), "time": k}) for k, (rows, gone) in enumerate([([["a", "1"], ["b", "2"]], ()), ([["a", "9"], ["b", None]], (1,))])))
    assert cli.read_log(spark, str(log)) == "id,v\na,9\n"


def test_cli_writes_to_a_log(spark, tmp_path):
    folder, path = str(tmp_path / "log"), tmp_path / "a.csv"
    path.write_text("sku,qty\nA,1\nB,2\n")
    assert cli.write(spark, str(path), folder) == 1
    path.write_text("sku,qty\nB,5\nC,7\n")
    assert cli.write(spark, str(path), folder, "sku", "me") == 1
    assert cli.read_log(spark, folder) == "sku,qty\nA,1\nB,5\nC,7\n"
    assert sorted((r.time, r.signer) for r in spark.read.schema(cli.LOG).json(folder).collect()) == [(0, None), (1, "me")]
