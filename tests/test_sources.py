from datetime import date

import pytest
from conftest import collected
from pyspark.sql import functions as F

from snapgate.contracts import ContractError
from snapgate.plans import datasets
from snapgate.queries import QUERIES
from snapgate.sources import files, jdbc
from snapgate.sources.payloads import read_responses


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_values_stay_text(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,zip,city\n1,01234, são paulo \n2,,x\n")
    df = files.read_csv_snapshot(spark, path, ["id", "zip"])
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string"] * 4
    assert collected(df, "id", "zip", "city") == [("1", "01234", " são paulo "), ("2", None, "x")]
    assert df.first().source_file.endswith("/c.csv")


def test_missing_required_column(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,extra\n1,2\n")
    with pytest.raises(ContractError, match="zip"):
        files.read_csv_snapshot(spark, path, ["id", "zip"])
    with pytest.raises(ContractError):
        files.read_csv_snapshot(spark, path, [])


def test_multiline_reviews(spark, tmp_path):
    path = write(tmp_path / "r.csv", (
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,"say ""hi""","first line\nsecond line",2018-01-01,2018-01-02\n'))
    required = datasets.source_columns(datasets.ORDER_REVIEWS)
    df = files.read_csv_snapshot(spark, path, required, multiline=True, escape='"')
    assert collected(df, "review_comment_title", "review_comment_message") == [
        ('say "hi"', "first line\nsecond line")]


def test_empty_texts_and_nuls_land_unchanged(spark, tmp_path):
    # empty texts came back as NULL, NULs beside quotes and line breaks were dropped.
    texts = ["", None, "a", "\0\n", "\n\0", '\0"', '"\0', "a\0b", '""', "\r\n\0,\r"]
    docs = spark.createDataFrame([*enumerate(texts), (None, ""), (None, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    landed = QUERIES["land_multiline_csv"](spark, str(tmp_path))
    wanted = docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "md5(text) AS text_md5")
    assert collected(landed) == collected(wanted)


def test_quoted_empty_fields_are_kept_on_request(spark, tmp_path):
    path = write(tmp_path / "e.csv", 'id,a,b\n1,"",\n2,x,""\n')
    assert collected(files.read_csv_snapshot(spark, path, ["id"]), "a", "b") == [("x", None), (None, None)]
    kept = files.read_csv_snapshot(spark, path, ["id"], keep_empty=True)
    assert collected(kept, "a", "b") == [("", None), ("x", "")]


FUEL_HEADING = ";".join(files.FUEL_PRICE_HEADINGS)


def test_fuel_prices(spark, tmp_path):
    line = "SE;SP;SÃO PAULO;POSTO;1;RUA;10;{c};CENTRO;1;GASOLINA;{d};{v};{p};R$;BRANCA"
    path = write(tmp_path / "fuel.csv", "\n".join([
        FUEL_HEADING, line.format(c="", d="04/01/2016", v="3,599", p=""),
        line.format(c="LOJA 1", d="31/02/2016", v="x", p="2,1")]) + "\n")
    df = files.read_fuel_prices(spark, path)
    found = collected(df.selectExpr(
        "complemento", "data_coleta", "CAST(valor_venda AS DOUBLE)", "CAST(valor_compra AS DOUBLE)",
        "source_file", "typeof(valor_venda) AS t"))
    assert found == sorted([
        (None, date(2016, 1, 4), 3.599, None, "fuel.csv", "decimal(38,18)"),
        ("LOJA 1", None, None, 2.1, "fuel.csv", "decimal(38,18)")], key=repr)


_ROW = ["SE", "SP", "SÃO PAULO", "POSTO", "1", "RUA", "10", "", "CENTRO", "1", "GASOLINA", "04/01/2016", "3,5", "", "R$", "BRANCA"]


def fuel_file(path, order, *rows, mark=""):
    headings = list(files.FUEL_PRICE_HEADINGS)
    lines = [mark + ";".join(headings[i].upper() for i in order)]
    return write(path, "\n".join(lines + [";".join(r) for r in rows]) + "\n")


def test_headings_name_the_columns_of_each_file(spark, tmp_path):
    swapped = [2, 1, 0, *range(3, 16)]
    fuel_file(tmp_path / "in" / "plain.csv", range(16), _ROW)
    fuel_file(tmp_path / "in" / "swapped.csv", swapped, [_ROW[i] for i in swapped], mark="\ufeff")
    fuel_file(tmp_path / "in" / "both.csv", swapped, [_ROW[i] for i in swapped], [_ROW[i] for i in swapped])
    df = files.read_fuel_prices(spark, str(tmp_path / "in"))
    found = collected(df.select("source_file", "regiao_sigla", "municipio", "refused", "cast_failed"))
    assert found == sorted([(f, "SE", "SÃO PAULO", None, False) for f in ("plain.csv", "swapped.csv", "both.csv", "both.csv")], key=repr)


def test_rows_that_do_not_fit_are_refused(spark, tmp_path):
    fuel_file(tmp_path / "in" / "short.csv", range(16), _ROW, _ROW[:12])
    fuel_file(tmp_path / "in" / "long.csv", range(16), [*_ROW, "more"])
    write(tmp_path / "in" / "other.csv", ";".join(f"c{i}" for i in range(16)) + "\n" + ";".join(_ROW) + "\n")
    write(tmp_path / "in" / "twice.csv", "\n".join([FUEL_HEADING, ";".join(reversed(FUEL_HEADING.split(";"))), ";".join(_ROW)]) + "\n")
    df = files.read_fuel_prices(spark, str(tmp_path / "in"))
    assert collected(df.groupBy("source_file", "refused").count()) == sorted([
        ("short.csv", None, 1), ("short.csv", "row length", 1), ("long.csv", "row length", 1),
        ("other.csv", "headings", 2), ("twice.csv", "headings", 1)], key=repr)
    # The same whichever columns are read.
    assert df.where("refused = 'row length'").select("refused").count() == 2


@pytest.mark.parametrize("name, row", [("short", _ROW[:15]), ("long", [*_ROW, ""])])
def test_load_stops_at_rows_of_another_length(spark, tmp_path, name, row):
    from snapgate.plans.feeds import load_fuel_files

    fuel_file(tmp_path / "in" / "odd.csv", range(16), _ROW, row)
    with pytest.raises(ContractError, match="row length"):
        load_fuel_files(spark, str(tmp_path / "in"), f"fuel_{name}", f"fuel_{name}_ledger")
    assert not spark.catalog.tableExists(f"fuel_{name}") and _ledger_rows(spark, f"fuel_{name}_ledger") == []


def test_only_new_files_are_parsed(spark, tmp_path, monkeypatch):
    from snapgate.plans import feeds

    asked = []
    read = feeds.read_fuel_prices
    monkeypatch.setattr(feeds, "read_fuel_prices", lambda session, paths: asked.append(paths) or read(session, paths))
    folder = tmp_path / "in"
    names = ["a.csv", "b [1]{x} %20.csv"]
    for n, name in enumerate(names):
        fuel_file(folder / name, range(16), *[_ROW] * (n + 1))
        assert feeds.load_fuel_files(spark, str(folder), "fuel_new", "fuel_new_ledger") == 1
        assert feeds.load_fuel_files(spark, str(folder), "fuel_new", "fuel_new_ledger") == 0
    assert [len(paths) for paths in asked] == [1, 1]
    assert collected(spark.table("fuel_new").groupBy("source_file").count()) == [("a.csv", 1), ("b [1]{x} %20.csv", 2)]


def test_ledger_skips_loaded_content_and_keeps_copies(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    write(tmp_path / "in" / "a.csv", "same")
    write(tmp_path / "in" / "b.csv", "same")
    write(tmp_path / "in" / "c.csv", "other")
    hashes = files.file_hashes(spark, folder, "*.csv")
    assert hashes.select("content_hash").distinct().count() == 2
    known = hashes.where("source_file LIKE '%c.csv'").first().content_hash
    ledger = rows([("c.csv", known, 1, "SUCCESS"), ("x.csv", "0" * 64, 1, "FAILED")], files.LEDGER_SCHEMA)
    left = files.unseen_content(hashes, ledger)
    assert sorted(r.source_file[-5:] for r in left.collect()) == ["a.csv", "b.csv"]
    failed = ledger.withColumn("status", F.lit("FAILED"))
    assert files.unseen_content(hashes, failed).count() == 3


def test_inventory_and_file_profile(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(tmp_path / "in" / "a.csv", 'id,"name"\n1,x\n2,y\n')
    write(tmp_path / "in" / "b.csv", 'id,text\n1,"one\ntwo"\n')
    write(tmp_path / "in" / "empty.csv", "only,header,here\n")
    write(tmp_path / "in" / "note.txt", "not a csv")
    listed = files.file_inventory(spark, folder, "*.csv", group="g")
    assert collected(listed, "group", "name", "size_bytes") == [
        ("g", "a.csv", 18), ("g", "b.csv", 20), ("g", "empty.csv", 17)]
    assert collected(files.inventory_totals(listed)) == [("g", 3, 55)]

    def shape(df):
        short = F.element_at(F.split("source_file", "/"), -1)
        return collected(df.select(short, "row_count", "column_count", F.concat_ws("|", "columns")))

    assert shape(files.profile_files(spark, folder + "/*.csv")) == [
        ("a.csv", 2, 2, "id|name"), ("b.csv", 2, 2, "id|text"), ("empty.csv", 0, 3, "only|header|here")]
    assert shape(files.profile_files(spark, folder + "/*.csv", multiline=True)) == [
        ("a.csv", 2, 2, "id|name"), ("b.csv", 1, 2, "id|text"), ("empty.csv", 0, 3, "only|header|here")]


def test_responses_come_from_files(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", '{"a":1}\n{"a":2}\n')
    assert collected(read_responses(spark, path), "payload_json") == [('{"a":1}',), ('{"a":2}',)]
    assert read_responses(spark, path, whole_files=True).count() == 1


# -- JDBC: what is sent to the database; no database is started -------------------------


def test_month_predicates_cover_the_window_once():
    assert jdbc.month_predicates("d", date(2015, 12, 30), date(2016, 2, 1)) == [
        "d >= DATE '2015-12-30' AND d < DATE '2016-01-01'",
        "d >= DATE '2016-01-01' AND d < DATE '2016-02-01'",
        "d >= DATE '2016-02-01' AND d < DATE '2016-02-02'"]
    with pytest.raises(ContractError):
        jdbc.month_predicates("d", date(2016, 1, 2), date(2016, 1, 1))


def test_month_predicates_keep_the_end_of_every_last_day(rows):
    times = rows([(f"2016-0{m}-{d} 23:59:59",) for m, d in ((1, 31), (2, 29), (3, 31))], "s string")
    at = times.selectExpr("CAST(s AS TIMESTAMP) AS d")
    predicates = jdbc.month_predicates("d", date(2016, 1, 1), date(2016, 3, 31))
    assert [at.where(p).count() for p in predicates] == [1, 1, 1]


def test_jdbc_options_are_required():
    options = {"url": "jdbc:x", "user": "u", "password": "p", "driver": "d"}
    assert jdbc.checked_options(options) == options
    with pytest.raises(ContractError, match="password"):
        jdbc.checked_options({**options, "password": " "})


def test_window_reaches_the_scan(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    rows([("2016-01-03", 1), ("2016-01-04", 2), ("2016-06-30", 3), ("2016-07-01", 4)], "s string, v int") \
        .selectExpr("CAST(s AS DATE) AS data_coleta", "v").write.parquet(path)
    df = jdbc.in_window(
        spark.read.parquet(path), "data_coleta", date(2016, 1, 4), date(2016, 6, 30), "db")
    assert collected(df, "v", "dt_base", "source_system") == [
        (2, date(2016, 1, 4), "db"), (3, date(2016, 6, 30), "db")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(data_coleta" in plan and "LessThan(data_coleta" in plan
    with pytest.raises(ContractError):
        jdbc.in_window(df, "data_coleta", date(2016, 1, 2), date(2016, 1, 1), "db")


def test_window_includes_the_last_day_of_a_timestamp(rows):
    df = rows([("2016-06-30 23:59:59",), ("2016-07-01 00:00:00",)], "s string").selectExpr(
        "CAST(s AS TIMESTAMP) AS at")
    assert jdbc.in_window(df, "at", date(2016, 6, 30), date(2016, 6, 30), "db").count() == 1


def test_snapshots_with_another_column_order_are_refused(spark, tmp_path):
    write(tmp_path / "s" / "a.csv", "id,name,city\n1,ana,spo\n")
    write(tmp_path / "s" / "b.csv", "city,id,name\nrio,2,bia\n")
    landed = files.read_csv_snapshot(spark, str(tmp_path / "s"), ["id", "name", "city"])
    with pytest.raises(Exception, match="CSV header does not conform"):
        landed.collect()


def test_quoted_headings_hold_separators(spark, tmp_path):
    write(tmp_path / "h" / "a.csv", 'id,"a,b","say ""x""", plain\n1,2,3,4\n')
    found = files.profile_files(spark, str(tmp_path / "h")).collect()
    assert [(r.row_count, r.column_count, r.columns) for r in found] == [
        (1, 4, ["id", "a,b", 'say "x"', " plain"])]


def test_files_with_bad_values_stop_the_load_and_empty_files_are_entered(spark, tmp_path):
    from snapgate.plans.feeds import load_fuel_files

    line = "SE;SP;X;P;1;R;1;;C;1;GASOLINA;04/01/2016;3,5;;R$;B"
    folder = tmp_path / "in"
    write(folder / "bad.csv", f"{FUEL_HEADING}\n{line.replace('3,5', 'cheap')}\n")
    with pytest.raises(ContractError, match="bad.csv"):
        load_fuel_files(spark, str(folder), "fuel_bad", "fuel_bad_ledger")
    assert _ledger_rows(spark, "fuel_bad_ledger") == []
    write(folder / "bad.csv", f"{FUEL_HEADING}\n{line}\n")
    write(folder / "none.csv", f"{FUEL_HEADING}\n")
    assert load_fuel_files(spark, str(folder), "fuel_bad", "fuel_bad_ledger") == 2
    assert _ledger_rows(spark, "fuel_bad_ledger") == [(0, "SUCCESS"), (1, "SUCCESS")]
    assert load_fuel_files(spark, str(folder), "fuel_bad", "fuel_bad_ledger") == 0


def _ledger_rows(spark, ledger):
    return collected(spark.table(ledger).selectExpr("row_count", "status"))


def test_files_are_loaded_once_by_content(spark, tmp_path):
    from snapgate.plans.feeds import load_fuel_files

    line = "SE;SP;X;P;1;R;1;;C;1;GASOLINA;04/01/2016;3,5;;R$;B"
    folder = tmp_path / "in"
    write(folder / "a.csv", f"{FUEL_HEADING}\n{line}\n{line}\n")
    write(folder / "copy.csv", f"{FUEL_HEADING}\n{line}\n{line}\n")
    assert load_fuel_files(spark, str(folder), "fuel_source", "fuel_ledger") == 1
    assert _ledger_rows(spark, "fuel_ledger") == [(2, "SUCCESS")]
    assert load_fuel_files(spark, str(folder), "fuel_source", "fuel_ledger") == 0
    write(folder / "b ção+1.csv", f"{FUEL_HEADING}\n{line}\n")
    assert load_fuel_files(spark, str(folder), "fuel_source", "fuel_ledger") == 1
    assert _ledger_rows(spark, "fuel_ledger") == [(1, "SUCCESS"), (2, "SUCCESS")]
    assert spark.table("fuel_source").count() == 3
    assert collected(spark.table("fuel_source").select("source_file").distinct()) == [
        ("a.csv",), ("b ção+1.csv",)]


def _tree(values, fanout, levels):
    import hashlib
    at = [hashlib.sha256(v).hexdigest() for v in values]
    for _ in range(levels):
        at = [hashlib.sha256("".join(at[k:k + fanout]).encode()).hexdigest() for k in range(0, len(at), fanout)]
    return at[0]


def test_digests_of_files_do_not_depend_on_their_splits(spark, tmp_path):
    import hashlib
    many = b"".join(b"line %d\r\n" % (k % 50) for k in range(9000))
    contents = {"a.csv": many, "b.csv": many, "c.csv": many[:-1], "d.csv": b"", "e.csv": b"\n", "f.csv": b"x\xff\n\ny",
                "g.csv": b"line 1\r\nline 0\r\n" + many[18:], "[h] 1.csv": b"short"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("7000", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found.append({r.source_file.rsplit("/", 1)[1]: r.content_hash
                          for r in files.file_digests(spark, str(tmp_path), "*.csv").collect()})
            numbers = files.numbered_lines(spark, str(tmp_path), "a.csv").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [r.value for r in sorted(numbers, key=lambda r: r.number)] == [f"line {k % 50}\r" for k in range(9000)]
        assert sorted(r.number for r in numbers) == list(range(9000))
    del contents["d.csv"]  # Spark lists no file without bytes
    assert found[0] == found[1] and len(found[0]) == len(contents)
    for name, content in contents.items():
        lines = content.split(b"\n")[:-1] if content.endswith(b"\n") else content.split(b"\n")
        root = _tree(lines, files.FANOUT, files.LEVELS) if content else ""
        assert found[0][name] == hashlib.sha256(f"{len(content)}:{root}".encode()).hexdigest(), name
    assert len(set(found[0].values())) == len(contents) - 1


def test_ordered_digests_of_odd_groups(rows):
    data = [(None, 0, "a"), (None, 1, None), (1, 0, ""), (1, 1, "a"), (2, 0, "b")]
    made = {r.k: r.digest for r in files.ordered_digests(
        rows(data, "k int, n int, v string"), "k", "n", "v", fanout=2, levels=1).collect()}
    assert made == {None: _tree([b"a", b""], 2, 1), 1: _tree([b"", b"a"], 2, 1), 2: _tree([b"b"], 2, 1)}
    assert files.ordered_digests(rows([], "k int, n int, v string"), "k", "n", "v").count() == 0
    too_many = files.ordered_digests(rows([(1, k, "x") for k in range(3)], "k int, n int, v string"),
                                     "k", "n", "v", fanout=2, levels=1)
    with pytest.raises(Exception, match="more than 2"):
        too_many.collect()
