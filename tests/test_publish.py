import uuid
from datetime import date

import pytest
from conftest import collected
from pyspark.sql import functions as F

from snapgate.contracts import ContractError, stamp_ingestion
from snapgate.operators.write import EmptyScope
from snapgate.plans import catalog, datasets, feeds, silver, sinks
from snapgate.plans.publish import (
    ControlTables,
    current_runs,
    land_csv,
    latest_evidence,
    merge_checked,
    publish_snapshot,
)
from snapgate.quality.evaluate import QualityRejected


@pytest.fixture
def names():
    """Fresh table names per test."""
    tag = uuid.uuid4().hex[:8]
    return f"target_{tag}", ControlTables(f"evidence_{tag}", f"runs_{tag}")


CUSTOMER_DDL = ("customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
                "customer_city string, customer_state string, source_file string")


def customers(rows, *changes):
    base = dict(id="1", unique="p", zip="01234", city="c", state="s", file="f")
    return rows([tuple({**base, **c}.values()) for c in changes], CUSTOMER_DDL)


def publish(spark, df, names, **options):
    table, control = names
    return publish_snapshot(
        spark, df, datasets.CUSTOMERS, catalog.CUSTOMERS, table, control=control, **options)


def last_run(spark, control, run_id):
    return current_runs(spark, control).where(F.col("run_id") == run_id).first()


def test_publish_replaces_and_records(spark, rows, names):
    table, control = names
    first = publish(spark, customers(rows, {"id": "1"}, {"id": "2"}), names)
    assert (first.outcome, first.row_count, first.key) == ("PASSED", 2, ("customer_id",))
    assert spark.table(table).columns == list(datasets.CUSTOMERS.column_names)
    publish(spark, customers(rows, {"id": "3"}), names)
    assert collected(spark.table(table), "customer_id") == [("3",)]
    run = last_run(spark, control, first.run.run_id)
    assert (run.status, run.records_written, run.quality_status) == ("SUCCEEDED", 2, "PASSED")
    assert latest_evidence(spark.table(control.evidence)).count() == 10


def test_rejected_snapshot_leaves_evidence_and_target(spark, rows, names):
    table, control = names
    publish(spark, customers(rows, {}), names)
    with pytest.raises(QualityRejected) as error:
        publish(spark, customers(rows, {"zip": "bad"}, {"id": "2", "city": None}), names, run_id="r2")
    assert error.value.rule_ids == ["CUSTOMERS-DQ04", "CUSTOMERS-DQ05"]
    assert collected(spark.table(table), "customer_zip_code_prefix") == [("01234",)]
    failed = spark.table(control.evidence).where("run_id = 'r2' AND status = 'FAIL'")
    assert failed.count() == 2
    run = last_run(spark, control, "r2")
    assert (run.status, run.error_stage, run.records_written) == ("REJECTED", "QUALITY", 0)


def test_rejected_first_publish_creates_no_table(spark, rows, names):
    with pytest.raises(QualityRejected):
        publish(spark, customers(rows, {"id": None}), names)
    assert not spark.catalog.tableExists(names[0])


def test_empty_silver_snapshot_keeps_target(spark, rows, names):
    table, control = names
    bronze = stamp_ingestion(customers(rows, {}))

    def run(df, run_id):
        return publish_snapshot(
            spark, silver.customers(df), datasets.SILVER_CUSTOMERS, catalog.SILVER_CUSTOMERS,
            table, control=control, run_id=run_id)

    run(bronze, "s1")
    with pytest.raises(EmptyScope):
        run(bronze.where("false"), "s2")
    assert spark.table(table).count() == 1
    assert last_run(spark, control, "s2").status == "FAILED"


def test_evidence_flags_do_not_reach_the_table(spark, rows, names):
    table, control = names
    ddl = "order_id string, customer_id string, order_status string, " + ", ".join(
        f"{c} string" for c in ("order_purchase_timestamp", "order_approved_at",
                                "order_delivered_carrier_date", "order_delivered_customer_date",
                                "order_estimated_delivery_date")) + ", source_file string"
    bronze = stamp_ingestion(rows(
        [("o", "c", "s", "2017-01-01", None, None, None, "2017-02-01", "f")], ddl))
    df = silver.orders(bronze, rows([("c",)], "customer_id string"))
    assert any(c.startswith("_") for c in df.columns)
    publish_snapshot(spark, df, datasets.SILVER_ORDERS, catalog.SILVER_ORDERS, table, control=control)
    assert spark.table(table).columns == list(datasets.SILVER_ORDERS.column_names)
    assert spark.table(table).first().order_purchase_timestamp is not None


def test_source_is_read_once(spark, rows, names, tmp_path):
    """What is checked is what is written, even when the source changes in between."""
    df = customers(rows, {"id": "1"}, {"id": "2"}).withColumn("customer_city", F.uuid())
    publish(spark, df, names)
    first = collected(spark.table(names[0]), "customer_city")
    assert collected(spark.table(names[0]), "customer_city") == first


def test_batch_type_mismatch_fails_before_any_write(spark, rows, names):
    bad = customers(rows, {}).withColumn("customer_id", F.lit(1))
    with pytest.raises(ContractError, match="customer_id:int->string"):
        publish(spark, bad, names, run_id="t1")
    assert last_run(spark, names[1], "t1").error_type == "ContractError"


def test_keyless_snapshot_keeps_duplicates(spark, rows, names):
    table, control = names
    row = ("1234", "-23.5", "-46.6", "são paulo", "SP", "f")
    ddl = ("geolocation_zip_code_prefix string, geolocation_lat string, geolocation_lng string, "
           "geolocation_city string, geolocation_state string, source_file string")
    published = publish_snapshot(
        spark, rows([row, row], ddl), datasets.GEOLOCATION, catalog.GEOLOCATION, table, control=control)
    assert published.key == () and spark.table(table).count() == 2


def test_repeated_run_replaces_its_evidence(spark, rows, names):
    _, control = names
    with pytest.raises(QualityRejected):
        publish(spark, customers(rows, {"zip": "bad"}), names, run_id="r")
    publish(spark, customers(rows, {}), names, run_id="r")
    publish(spark, customers(rows, {}), names, run_id="r", scope='{"part":2}')
    stored = spark.table(control.evidence)
    assert stored.count() == 10 and stored.where("status = 'FAIL'").count() == 0


def test_land_csv(spark, tmp_path, names):
    table, control = names
    (tmp_path / "sellers.csv").write_text(
        "seller_id,seller_zip_code_prefix,seller_city,seller_state,surplus\ns1,01234,x,SP,?\n")
    landed = land_csv(spark, str(tmp_path / "sellers.csv"), datasets.SELLERS, catalog.SELLERS,
                      table, control=control)
    row = spark.table(table).first()
    assert landed.row_count == 1 and row.seller_zip_code_prefix == "01234"
    assert row.source_file.endswith("sellers.csv") and row.ingestion_timestamp is not None
    assert "surplus" not in spark.table(table).columns


# -- keyed and windowed feeds -----------------------------------------------------------


def observations(rows, *data):
    ddl = ("municipality_code string, reference_year string, variable_code string, d string, "
           "j string, request_id string")
    return rows(list(data), ddl).selectExpr(
        "municipality_code", "reference_year", "variable_code", "CAST(d AS DATE) AS dt_base",
        "parse_json(j) AS payload", "request_id")


def seen(spark, table):
    return collected(spark.table(table).selectExpr(
        "municipality_code", "reference_year", "to_json(payload)", "dt_month"))


def population(spark, df, periods, names):
    table, control = names
    return feeds.ingest_observations(
        spark, df, catalog.POPULATION_SOURCE, periods, table, control=control)


def test_merge_updates_inserts_and_keeps(spark, rows, names):
    table, _ = names
    first = observations(
        rows, ("1", "2016", "9324", "2016-01-01", '{"v":1}', "a"),
        ("2", "2016", "9324", "2016-01-01", '{"v":2}', "a"),
        ("1", "2017", "9324", "2017-01-01", '{"v":3}', "a"))
    population(spark, first, ["2016", "2017"], names)
    second = observations(
        rows, ("1", "2016", "9324", "2016-01-01", '{"v":10}', "b"),
        ("1", "2018", "9324", "2018-01-01", '{"v":4}', "b"))
    population(spark, second, ["2016", "2018"], names)
    expected = [("1", "2016", '{"v":10}', "2016-01"), ("1", "2017", '{"v":3}', "2017-01"),
                ("1", "2018", '{"v":4}', "2018-01"), ("2", "2016", '{"v":2}', "2016-01")]
    assert seen(spark, table) == expected
    population(spark, second, ["2016", "2018"], names)
    assert seen(spark, table) == expected


def test_merge_refuses_rows_without_a_date(spark, rows, names):
    table, _ = names
    sinks.create_table(spark, sinks.by_month(datasets.MUNICIPALITY_POPULATION), table)
    good = observations(rows, ("1", "2016", "9324", "2016-01-01", '{"v":1}', "a"))
    keys = ["municipality_code", "reference_year", "variable_code"]
    sinks.merge_table(spark, table, stamp_ingestion(good), keys)
    for bad in (("2", "abc", "9324", None, '{"v":2}', "a"),):
        mixed = observations(rows, bad, ("3", "2017", "9324", "2017-01-01", '{"v":3}', "a"))
        for batch in (observations(rows, bad), mixed):
            with pytest.raises(ContractError, match="dt_base"):
                sinks.merge_table(spark, table, stamp_ingestion(batch), keys)
    assert seen(spark, table) == [("1", "2016", '{"v":1}', "2016-01")]


def test_merge_moves_a_row_whose_month_changes(spark, rows, names):
    table, _ = names
    sinks.create_table(spark, sinks.by_month(datasets.MUNICIPALITY_POPULATION), table)
    keys = ["municipality_code", "reference_year", "variable_code"]
    for day, value in (("2016-01-01", 1), ("2016-03-01", 2)):
        batch = observations(rows, ("1", "2016", "9324", day, f'{{"v":{value}}}', "a"))
        sinks.merge_table(spark, table, stamp_ingestion(batch), keys)
    assert seen(spark, table) == [("1", "2016", '{"v":2}', "2016-03")]


def test_merged_tables_take_new_nullable_columns(spark, names):
    from dataclasses import replace

    from snapgate.contracts import Column as ContractColumn

    table, _ = names
    contract = sinks.by_month(datasets.MUNICIPALITY_POPULATION)
    sinks.create_table(spark, contract, table)
    wider = replace(contract, columns=(*contract.columns, ContractColumn("note", "string", True, "A note.")))
    with pytest.raises(ContractError):
        sinks.create_table(spark, replace(wider, evolve_nullable=False), table)
    sinks.create_table(spark, replace(wider, evolve_nullable=True), table)
    assert "note" in spark.table(table).columns


def test_merge_refuses_bad_keys_and_absent_periods(spark, rows, names):
    row = ("1", "2016", "9324", "2016-01-01", '{"v":1}', "a")
    with pytest.raises(EmptyScope, match="2017"):
        population(spark, observations(rows, row), ["2016", "2017"], names)
    with pytest.raises(ContractError, match="unique"):
        population(spark, observations(rows, row, row), ["2016"], names)
    with pytest.raises(ContractError, match="code is present"):
        population(spark, observations(rows, (None, *row[1:]), row), ["2016"], names)
    assert not spark.catalog.tableExists(names[0])


def test_gdp_gate(spark, rows, names):
    table, control = names
    grid = [("1", "2016", v, "2016-01-01", '{"Valor":"1"}', "a") for v in catalog.GDP_SOURCE.variables]

    def ingest(data):
        return feeds.ingest_observations(
            spark, observations(rows, *data), catalog.GDP_SOURCE, ["2016"], table, control=control)

    assert ingest(grid).key == ("municipality_code", "reference_year", "variable_code")
    with pytest.raises(QualityRejected) as error:
        ingest(grid[1:] + grid[1:2])
    assert error.value.rule_ids == ["GDP-DQ03", "GDP-DQ07"]
    assert spark.table(table).count() == 6


def test_merge_needs_a_merge_contract(spark, rows, names):
    with pytest.raises(ContractError):
        merge_checked(spark, customers(rows, {}), datasets.CUSTOMERS, catalog.CUSTOMERS, names[0])


def fuel(rows, *data):
    names = [c.name for c in datasets.FUEL_PRICES.columns if c.name not in ("dt_base", "source_system")]
    df = rows(list(data), "id bigint, d string, v string")
    typed = {"id": F.col("id"), "data_coleta": F.col("d").cast("date"),
             "valor_venda": F.col("v").cast("decimal(38,18)"),
             "valor_compra": F.lit(None).cast("decimal(38,18)")}
    return df.select(*[typed.get(n, F.lit("x")).alias(n) for n in names])


def test_fuel_window_replaces_only_its_days(spark, rows, names):
    table, _ = names
    load = fuel(rows, (1, "2016-01-31", "1"), (2, "2016-02-01", "2"), (3, "2016-02-20", "3"),
                (4, "2016-03-05", "4"))
    assert feeds.fuel_price_window(spark, load, table, date(2016, 1, 1), date(2016, 3, 31), "db") == 4
    again = fuel(rows, (5, "2016-02-20", "9"), (6, "2016-04-01", "9"))
    assert feeds.fuel_price_window(spark, again, table, date(2016, 2, 10), date(2016, 3, 31), "db") == 1
    found = collected(spark.table(table).selectExpr("id", "dt_month", "CAST(valor_venda AS INT)"))
    assert found == [(1, "2016-01", 1), (2, "2016-02", 2), (5, "2016-02", 9)]
    parts = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    assert parts == {"dt_month=2016-01", "dt_month=2016-02"}


def test_empty_fuel_window_keeps_the_table(spark, rows, names):
    table, _ = names
    load = fuel(rows, (1, "2016-01-31", "1"))
    feeds.fuel_price_window(spark, load, table, date(2016, 1, 1), date(2016, 1, 31), "db")
    with pytest.raises(EmptyScope):
        feeds.fuel_price_window(spark, load, table, date(2017, 1, 1), date(2017, 1, 31), "db")
    assert spark.table(table).count() == 1


def weather(rows, days, latitude=-23.5):
    import json

    payload = {"timezone": "x", "daily": {"time": days, "temperature_2m_mean": [1.0] * len(days),
                                          "rain_sum": [0.0] * len(days)}}
    df = rows([(json.dumps(payload),)], "payload_json string")
    return feeds.weather_rows(df, latitude, -46.6, "r")


def test_weather_ingest_and_reprocess(spark, rows, names):
    table, control = names
    assert feeds.ingest_weather(spark, weather(rows, ["2017-01-01"]).where("false"), table, control) is None
    feeds.ingest_weather(spark, weather(rows, ["2017-01-01", "2017-01-02"]), table, control)
    feeds.ingest_weather(spark, weather(rows, ["2017-01-01"], latitude=10.0), table, control)
    assert spark.table(table).count() == 3
    window = (date(2017, 1, 1), date(2017, 1, 31))
    feeds.reprocess_weather(spark, weather(rows, ["2017-01-05"]), table, *window, -23.5, -46.6)
    assert collected(spark.table(table), "dt_base", "requested_latitude") == [
        (date(2017, 1, 1), 10.0), (date(2017, 1, 5), -23.5)]
    with pytest.raises(EmptyScope):
        feeds.reprocess_weather(
            spark, weather(rows, ["2017-01-05"]).where("false"), table, *window, -23.5, -46.6)


def test_municipality_snapshot_is_upserted_and_never_empty(spark, rows, names):
    table, control = names
    df = rows([('[{"id": 1, "nome": "A"}, {"id": 2, "nome": "B"}]',)], "payload_json string")
    batch = feeds.municipality_rows(df, date(2024, 1, 1), "r")
    feeds.ingest_municipalities(spark, batch, table, control)
    assert collected(spark.table(table), "municipality_code") == [("1",), ("2",)]
    with pytest.raises(EmptyScope):
        feeds.ingest_municipalities(spark, batch.where("false"), table, control)
    assert spark.table(table).count() == 2


@pytest.mark.parametrize("latitude, longitude", [(91, 0), (0, -181)])
def test_weather_coordinates_are_checked(rows, latitude, longitude):
    with pytest.raises(ContractError):
        feeds.weather_rows(rows([("{}",)], "payload_json string"), latitude, longitude, "r")


def test_create_table_detects_drift(spark, names):
    table, _ = names
    sinks.create_table(spark, datasets.CUSTOMERS, table)
    sinks.create_table(spark, datasets.CUSTOMERS, table)
    with pytest.raises(ContractError):
        sinks.create_table(spark, datasets.SELLERS, table)


def test_snapshots_to_conformed_tables(spark, tmp_path, names):
    """CSV files through landing and every conformed table, then a rejected orphan."""
    from snapgate.plans.pipelines import CONFORMED, conform_all, conform_dataset, land_dataset

    tag, control = names
    lines = {
        "customers": ["customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state",
                      "c1,person-1,01234,são paulo,SP", "c2,person-1,01234,são paulo,SP"],
        "sellers": ["seller_id,seller_zip_code_prefix,seller_city,seller_state", "s1,01234,x,SP"],
        "category_translation": ["product_category_name,product_category_name_english",
                                 "beleza_saude,health_beauty"],
        "products": ["product_id,product_category_name,product_name_lenght,product_description_lenght,"
                     "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,"
                     "product_width_cm", "p1,beleza_saude,1,2,3,100,1,1,1"],
        "orders": ["order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                   "order_delivered_carrier_date,order_delivered_customer_date,"
                   "order_estimated_delivery_date",
                   "o1,c1,delivered,2017-01-01 08:00:00,,,,2017-02-01 00:00:00"],
        "order_items": ["order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,"
                        "freight_value", "o1,1,p1,s1,2017-01-05 00:00:00,10.50,2.25"],
    }
    tables = {name: f"{tag}_{name}" for name in [*lines, *CONFORMED]}
    for name, text in lines.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(text) + "\n", encoding="utf-8")
        land_dataset(spark, name, str(tmp_path / f"{name}.csv"), tables[name], control=control)
    published = conform_all(spark, tables, control=control)
    assert {n: (p.outcome, p.row_count) for n, p in published.items()} == {
        n: ("PASSED", 2 if n == "silver_customers" else 1) for n in CONFORMED}
    item = spark.table(tables["silver_order_items"]).first()
    assert (item.order_item_id, str(item.price)) == (1, "10.50")
    assert spark.table(tables["silver_products"]).first().product_category_name_english == "health_beauty"

    (tmp_path / "orders2.csv").write_text(
        lines["orders"][0] + "\n" + lines["orders"][1].replace("c1", "nobody") + "\n")
    land_dataset(spark, "orders", str(tmp_path / "orders2.csv"), tables["orders"], control=control)
    with pytest.raises(QualityRejected) as error:
        conform_dataset(spark, "silver_orders", tables, control=control)
    assert error.value.rule_ids == ["SILVER-ORDERS-DQ05"]
    assert spark.table(tables["silver_orders"]).first().customer_id == "c1"
