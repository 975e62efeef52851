import json
from datetime import date, timedelta
from time import perf_counter

import pytest
from conftest import collected
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from snapgate.contracts import ContractError
from snapgate.operators import decode
from snapgate.plans import catalog, datasets, feeds

WEATHER = {
    "latitude": -23.5, "longitude": -46.6, "timezone": "America/Sao_Paulo",
    "daily_units": {"rain_sum": "mm"},
    "daily": {"time": ["2017-01-01", "2017-01-02"], "temperature_2m_mean": [20.5, None],
              "rain_sum": [0.0, 1.5], "model": "era5"},
}


def responses(rows, *payloads):
    return rows([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id int, payload_json string")


def transpose(df, **options):
    return decode.transpose_arrays(
        df, "payload_json", "daily", "time",
        {"temperature_2m_mean": "DOUBLE", "rain_sum": "DOUBLE"}, {"model": "STRING"}, **options)


def test_transpose_zips_lists_repeats_scalars_and_keeps_the_rest(rows):
    found = transpose(responses(rows, WEATHER)).orderBy("dt_base").collect()
    assert [(r.id, r.dt_base, r.temperature_2m_mean, r.rain_sum, r.model) for r in found] == [
        (0, date(2017, 1, 1), 20.5, 0.0, "era5"), (0, date(2017, 1, 2), None, 1.5, "era5")]
    payload = json.loads(found[1].payload_json)
    day = {"time": "2017-01-02", "temperature_2m_mean": None, "rain_sum": 1.5, "model": "era5"}
    assert payload == {**WEATHER, "daily": day}


def test_fields_nobody_named_stay_in_the_payload(rows):
    more = {**WEATHER["daily"], "wind": [3, 4.25], "note": "x \"y\""}
    df = responses(rows, {**WEATHER, "daily": more, "elevation": {"m": [760, 1]}})
    days = [json.loads(r.payload_json) for r in transpose(df).orderBy("dt_base").collect()]
    assert [d["daily"]["wind"] for d in days] == [3, 4.25]
    assert all(d["daily"]["note"] == 'x "y"' and d["elevation"] == {"m": [760, 1]} for d in days)
    landed = decode.land_payload(transpose(df), "payload_json")
    assert collected(landed, decode.payload_field("payload", "$.latitude", "double")) == [(-23.5,), (-23.5,)]
    short = responses(rows, {**WEATHER, "daily": {**more, "wind": [3]}})
    with pytest.raises(PySparkException):
        transpose(short).collect()


def test_long_lists_take_time_in_proportion(rows):
    """Eight times the days cost less than twice eight times the time of the shorter list."""
    first = date(1980, 1, 1)

    def seconds(days):
        times = [(first + timedelta(k)).isoformat() for k in range(days)]
        values = [k / 2 for k in range(days)]
        daily = {"time": times, "temperature_2m_mean": values, "rain_sum": values, "model": "m", "other": values}
        df = transpose(responses(rows, {**WEATHER, "daily": daily}))
        taken = []
        for _ in range(3):
            start = perf_counter()
            assert df.agg(F.count("payload_json"), F.sum("rain_sum")).first() == (days, sum(values))
            taken.append(perf_counter() - start)
        return min(taken)

    assert seconds(8000) < 16 * seconds(1000)


@pytest.mark.parametrize("text", ['{"error": "x"}', "no json", '[{"name": "x"}]', '[{"id": " "}]', "[1]"])
def test_malformed_snapshots_are_refused(rows, text):
    df = rows([('[{"id": 1}, {"id": "2"}]',), (text,)], "payload_json string")
    day = F.lit("2024-01-01").cast("date")
    with pytest.raises(PySparkException):
        decode.extract_snapshot(df, "payload_json", day).collect()
    found = decode.extract_snapshot(df, "payload_json", day, check=False)
    assert collected(found, "municipality_code") == [("1",), ("2",)]


@pytest.mark.parametrize("code,year,variable", [
    (" ", "2016", "37"), (None, "2016", "37"), ("1", "abc", "37"), ("1", "20160", "37"), ("1", "2016", "")])
def test_broken_observations_are_refused(rows, code, year, variable):
    payload = [{"D1C": feeds.CODE_LABEL, "D2C": feeds.YEAR_LABEL, "D3C": feeds.VARIABLE_LABEL},
               {"D1C": code, "D2C": year, "D3C": variable}, {"D1C": "2", "D2C": "2016", "D3C": "37"}]
    found = feeds.observation_rows(responses(rows, payload), "r")
    with pytest.raises(ContractError, match="1"):
        decode.check_observations(found)
    decode.check_observations(found.where("municipality_code = '2'"))


@pytest.mark.parametrize("daily", [
    {"time": ["2017-01-01", "2017-01-02"], "rain_sum": [1.0]},
    {"time": [], "rain_sum": []},
    {"rain_sum": [1.0]},
    {"time": ["2017-13-01"], "rain_sum": [1.0]},
    {"time": [None], "rain_sum": [1.0]},
])
def test_unusable_lists_fail_or_yield_nothing(rows, daily):
    df = responses(rows, {**WEATHER, "daily": daily})
    with pytest.raises(PySparkException):
        transpose(df).collect()
    assert transpose(df, check=False).count() == 0


def test_absent_list_is_null(rows):
    df = responses(rows, {"daily": {"time": ["2017-01-01"]}})
    assert collected(transpose(df), "rain_sum", "model") == [(None, None)]


def test_header_rows(rows):
    payload = [{"D1C": "Code", "V": "Value", "W": "Value"},
               {"D1C": "11", "V": "1", "W": "2", "new": "kept"}, {"D1C": None, "V": "..."}]
    found = decode.decode_header_rows(responses(rows, payload), "payload_json").collect()
    assert [r.record for r in found] == [
        {"Code": "11", "Value": "2", "new": "kept"}, {"Code": None, "Value": "..."}]
    assert found[0].id == 0


def test_header_only_has_no_rows_and_empty_payloads_fail(rows):
    assert decode.decode_header_rows(responses(rows, [{"a": "b"}]), "payload_json").count() == 0
    for payload in ([], [{}]):
        with pytest.raises(PySparkException):
            decode.decode_header_rows(responses(rows, payload), "payload_json").collect()
    assert decode.decode_header_rows(responses(rows, []), "payload_json", check=False).count() == 0


def test_observations(rows):
    header = {"A": feeds.CODE_LABEL, "B": feeds.YEAR_LABEL, "C": feeds.VARIABLE_LABEL, "V": "Valor"}
    payload = [header, {"A": "3550308", "B": "2016", "C": "37", "V": "1000"},
               {"A": " ", "B": "20x6", "C": "37", "V": "..."}]
    df = feeds.observation_rows(responses(rows, payload), "r1")
    datasets.MUNICIPALITY_GDP.check_batch(df)
    assert collected(df, "municipality_code", "reference_year", "variable_code", "dt_base") == sorted([
        ("3550308", "2016", "37", date(2016, 1, 1)), (" ", "20x6", "37", None)], key=repr)
    bad = {name: df.where(f"NOT coalesce({check}, false)").count()
           for name, check in decode.OBSERVATION_CHECKS.items()}
    assert bad == {"code is present": 1, "year is numeric": 1, "year has a date": 1,
                   "variable is present": 0}
    values = df.select(decode.payload_field("payload", "$.Valor"))
    assert collected(values) == [("...",), ("1000",)]


def test_current_snapshot_keeps_unknown_nested_fields(rows):
    payload = [{"id": 3550308, "nome": "São Paulo", "campo-novo": {"nested": True}}]
    df = feeds.municipality_rows(responses(rows, payload), date(2024, 1, 1), "r1")
    datasets.MUNICIPALITIES.check_batch(df)
    row = df.select(
        "municipality_code", "dt_base",
        decode.payload_field("payload", "$.nome").alias("nome"),
        decode.payload_field("payload", "$['campo-novo'].nested", "boolean").alias("nested"),
    ).first()
    assert tuple(row) == ("3550308", date(2024, 1, 1), "São Paulo", True)


def test_payload_survives_parquet(rows, spark, tmp_path):
    df = decode.land_payload(rows([('{"b":1,"a":[1,2]}',)], "j string"), "j")
    assert df.columns == ["payload"]
    df.write.parquet(str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).select(F.to_json("payload").alias("j"))
    assert collected(back) == [('{"a":[1,2],"b":1}',)]


def test_request_grid(rows):
    source = decode.StatisticsSource("s", 1685, 6, ("367", " 706 "), ("last 1",))
    df = decode.request_grid(rows([("last 1",), ("2017",), ("2017",)], "p string"), source, "p")
    assert collected(df, "path") == [
        ("/values/t/1685/n6/all/v/367/p/2017",), ("/values/t/1685/n6/all/v/367/p/last%201",),
        ("/values/t/1685/n6/all/v/706/p/2017",), ("/values/t/1685/n6/all/v/706/p/last%201",)]


@pytest.mark.parametrize("build, error", [
    (lambda: decode.StatisticsSource("s", 0, 6, ("1",)), ContractError),
    (lambda: decode.StatisticsSource("s", "1", 6, ("1",)), TypeError),
    (lambda: decode.StatisticsSource("s", 1, 6, ()), ContractError),
    (lambda: decode.StatisticsSource("s", 1, 6, (" ",)), ContractError),
])
def test_malformed_statistics_sources(build, error):
    with pytest.raises(error):
        build()


def test_published_sources():
    assert catalog.BUSINESS_SOURCE.default_periods == ("2016", "2017", "2018")
    assert catalog.GDP_SOURCE.default_periods == ("last 1",)
