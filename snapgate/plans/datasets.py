"""Table contracts of the landed (bronze) and conformed (silver) datasets, as data."""

from __future__ import annotations

from collections.abc import Mapping

from snapgate.contracts import INGESTED_AT, Column, TableContract, WriteStrategy


def _columns(text: str) -> tuple[Column, ...]:
    """Columns from lines of ``name | type | description``; ``!`` after a type is NOT NULL."""
    columns = []
    for line in text.strip().splitlines():
        name, type_, description = (part.strip() for part in line.split("|"))
        columns.append(Column(name, type_.rstrip("!"), not type_.endswith("!"), description))
    return tuple(columns)


_FILE = "source_file | string | File the row was read from."


def _snapshot(name: str, keys: tuple[str, ...], columns: str, description: str) -> TableContract:
    """A text snapshot landed as it is and replaced as a whole."""
    return TableContract(
        name=name, columns=_columns(columns.strip() + "\n" + _FILE), keys=keys,
        strategy=WriteStrategy.FULL_REPLACE, managed=(INGESTED_AT,), description=description,
        tags={"layer": "bronze"},
    )


# Column names, types, keys and nullability of the source datasets
# (spelling as published, including "lenght").
CUSTOMERS = _snapshot("customers", ("customer_id",), """
customer_id | string! | Customer of one order.
customer_unique_id | string | Person across orders.
customer_zip_code_prefix | string | First five digits of the postal code, as text.
customer_city | string | City as written in the source.
customer_state | string | State code as written in the source.
""", "Customers as delivered.")

SELLERS = _snapshot("sellers", ("seller_id",), """
seller_id | string! | Seller.
seller_zip_code_prefix | string | First five digits of the postal code, as text.
seller_city | string | City as written in the source.
seller_state | string | State code as written in the source.
""", "Sellers as delivered.")

PRODUCTS = _snapshot("products", ("product_id",), """
product_id | string! | Product.
product_category_name | string | Category in the source language.
product_name_lenght | string | Characters of the product name.
product_description_lenght | string | Characters of the description.
product_photos_qty | string | Number of photos.
product_weight_g | string | Weight in grams.
product_length_cm | string | Length in centimetres.
product_height_cm | string | Height in centimetres.
product_width_cm | string | Width in centimetres.
""", "Products as delivered.")

CATEGORY_TRANSLATION = _snapshot("category_translation", ("product_category_name",), """
product_category_name | string! | Category in the source language.
product_category_name_english | string! | Category in English.
""", "Category names and their translation.")

ORDERS = _snapshot("orders", ("order_id",), """
order_id | string! | Order.
customer_id | string! | Customer of the order.
order_status | string! | Life-cycle status.
order_purchase_timestamp | string! | Time of purchase, as text.
order_approved_at | string | Time of approval, as text.
order_delivered_carrier_date | string | Time of handover to the carrier, as text.
order_delivered_customer_date | string | Time of delivery, as text.
order_estimated_delivery_date | string! | Promised delivery, as text.
""", "Orders as delivered.")

ORDER_ITEMS = _snapshot("order_items", ("order_id", "order_item_id"), """
order_id | string! | Order.
order_item_id | string! | Position within the order.
product_id | string! | Product sold.
seller_id | string! | Seller of the item.
shipping_limit_date | string! | Latest handover to the carrier, as text.
price | string! | Item price, as text.
freight_value | string! | Freight share, as text.
""", "Order items as delivered.")

ORDER_PAYMENTS = _snapshot("order_payments", ("order_id", "payment_sequential"), """
order_id | string! | Order.
payment_sequential | string! | Position among the payments of the order.
payment_type | string! | Means of payment.
payment_installments | string! | Number of instalments, as text.
payment_value | string! | Amount, as text.
""", "Payments as delivered.")

ORDER_REVIEWS = _snapshot("order_reviews", ("review_id", "order_id"), """
review_id | string! | Review.
order_id | string! | Reviewed order.
review_score | string! | Score, as text.
review_comment_title | string | Title, free text.
review_comment_message | string | Message, free text that may span lines.
review_creation_date | string! | When the survey was sent, as text.
review_answer_timestamp | string! | When it was answered, as text.
""", "Reviews as delivered.")

GEOLOCATION = _snapshot("geolocation", (), """
geolocation_zip_code_prefix | string! | First digits of the postal code, as text.
geolocation_lat | string! | Latitude, as text.
geolocation_lng | string! | Longitude, as text.
geolocation_city | string! | City as written in the source.
geolocation_state | string! | State code as written in the source.
""", "Coordinates of postal codes; repeated rows are kept.")

QUALIFIED_LEADS = _snapshot("qualified_leads", ("mql_id",), """
mql_id | string! | Lead.
first_contact_date | string! | Day of first contact, as text.
landing_page_id | string! | Page the lead arrived on.
origin | string | Marketing channel.
""", "Marketing qualified leads as delivered.")

CLOSED_DEALS = _snapshot("closed_deals", ("mql_id",), """
mql_id | string! | Lead that was won.
seller_id | string | Seller it became.
sdr_id | string | Sales development representative.
sr_id | string | Sales representative.
won_date | string | When the deal was closed, as text.
business_segment | string | Segment declared by the seller.
lead_type | string | Kind of lead.
lead_behaviour_profile | string | Observed behaviour profile.
has_company | string | Whether a company is registered, as text.
has_gtin | string | Whether products carry trade numbers, as text.
average_stock | string | Declared stock.
business_type | string | Kind of business.
declared_product_catalog_size | string | Declared catalogue size, as text.
declared_monthly_revenue | string | Declared revenue, as text.
""", "Closed deals as delivered.")

# Window replacement works on months of dt_base, which are the table's partitions.
FUEL_PRICES = TableContract(
    name="fuel_prices", keys=("id",), strategy=WriteStrategy.REPLACE_WHERE,
    cluster_by=("dt_base",), managed=(INGESTED_AT,), tags={"layer": "bronze"},
    description="Surveyed fuel prices.",
    columns=_columns("""
id | bigint! | Row number given by the source database.
regiao_sigla | string | Region code.
estado_sigla | string | State code.
municipio | string | Municipality.
revenda | string | Station.
cnpj_revenda | string | Company number of the station.
nome_rua | string | Street.
numero_rua | string | House number.
complemento | string | Address supplement.
bairro | string | District.
cep | string | Postal code.
produto | string | Fuel.
data_coleta | date! | Survey day.
valor_venda | decimal(38,18)! | Selling price.
valor_compra | decimal(38,18) | Purchase price.
unidade_medida | string | Unit of the prices.
bandeira | string | Brand.
source_file | string! | File the row was loaded from.
dt_base | date! | Scope day; equals the survey day.
source_system | string! | Where the row was read from.
"""))


def _payload_table(name: str, keys: tuple[str, ...], columns: str, description: str) -> TableContract:
    """API payloads merged by key, kept whole as VARIANT."""
    tail = "\npayload | variant! | The observation as received.\nrequest_id | string! | Request that fetched it."
    return TableContract(
        name=name, keys=keys, columns=_columns(columns.strip() + tail),
        strategy=WriteStrategy.MERGE, cluster_by=("dt_base",), managed=(INGESTED_AT,),
        description=description, tags={"layer": "bronze"},
    )


WEATHER_DAILY = _payload_table(
    "weather_daily", ("dt_base", "requested_latitude", "requested_longitude"), """
dt_base | date! | Day of the observation.
requested_latitude | double! | Latitude asked for.
requested_longitude | double! | Longitude asked for.
""", "Daily weather payloads.")

MUNICIPALITIES = _payload_table("municipalities", ("municipality_code", "dt_base"), """
municipality_code | string! | Municipality.
dt_base | date! | Day of the snapshot.
""", "Municipality snapshots.")

_OBSERVATION_KEYS = ("municipality_code", "reference_year", "variable_code")
_OBSERVATION = """
municipality_code | string! | Municipality.
reference_year | string! | Year, as text.
variable_code | string! | Statistical variable.
dt_base | date! | First day of the year.
"""
MUNICIPALITY_POPULATION = _payload_table(
    "municipality_population", _OBSERVATION_KEYS, _OBSERVATION, "Population estimates.")
MUNICIPALITY_GDP = _payload_table(
    "municipality_gdp", _OBSERVATION_KEYS, _OBSERVATION, "Gross domestic product.")
MUNICIPALITY_BUSINESS = _payload_table(
    "municipality_business_activity", _OBSERVATION_KEYS, _OBSERVATION, "Business activity.")


def _conformed(name: str, keys: tuple[str, ...], columns: str, description: str) -> TableContract:
    """A typed table replaced as a whole, with landing and processing times."""
    tail = f"""
{_FILE}
bronze_ingestion_timestamp | timestamp | When the landed row was written.
silver_processed_timestamp | timestamp! | When this row was produced."""
    return TableContract(
        name=name, keys=keys, columns=_columns(columns.strip() + tail),
        strategy=WriteStrategy.FULL_REPLACE, description=description, tags={"layer": "silver"},
    )


SILVER_CUSTOMERS = _conformed("silver_customers", ("customer_id",), """
customer_id | string! | Customer of one order.
customer_unique_id | string! | Person across orders.
customer_zip_code_prefix | string | Postal code prefix; leading zeros kept.
customer_city | string | City at the time of the order.
customer_state | string | State at the time of the order.
""", "Conformed customers.")

SILVER_SELLERS = _conformed("silver_sellers", ("seller_id",), """
seller_id | string! | Seller.
seller_zip_code_prefix | string | Postal code prefix; leading zeros kept.
seller_city | string | City.
seller_state | string | State code.
""", "Conformed sellers.")

SILVER_CATEGORY_TRANSLATION = _conformed(
    "silver_category_translation", ("product_category_name",), """
product_category_name | string! | Category in the source language.
product_category_name_english | string! | Category in English.
""", "Conformed category names.")

SILVER_PRODUCTS = _conformed("silver_products", ("product_id",), """
product_id | string! | Product.
product_category_name | string | Category in the source language.
product_category_name_english | string | Category in English where translated.
product_name_length | int | Characters of the product name.
product_description_length | int | Characters of the description.
product_photos_qty | int | Number of photos.
product_weight_g | decimal(18,2) | Weight in grams.
product_length_cm | decimal(18,2) | Length in centimetres.
product_height_cm | decimal(18,2) | Height in centimetres.
product_width_cm | decimal(18,2) | Width in centimetres.
""", "Typed products with translated category.")

SILVER_ORDERS = _conformed("silver_orders", ("order_id",), """
order_id | string! | Order.
customer_id | string! | Customer; references silver customers.
order_status | string! | Life-cycle status.
order_purchase_timestamp | timestamp! | Time of purchase.
order_approved_at | timestamp | Time of approval.
order_delivered_carrier_date | timestamp | Time of handover to the carrier.
order_delivered_customer_date | timestamp | Time of delivery.
order_estimated_delivery_date | timestamp! | Promised delivery.
""", "Typed orders.")

SILVER_ORDER_ITEMS = _conformed("silver_order_items", ("order_id", "order_item_id"), """
order_id | string! | Order; references silver orders.
order_item_id | int! | Position within the order.
product_id | string! | Product; references silver products.
seller_id | string! | Seller; references silver sellers.
shipping_limit_date | timestamp! | Latest handover to the carrier.
price | decimal(18,2)! | Item price.
freight_value | decimal(18,2)! | Freight share.
""", "Typed order items.")

LANDED: Mapping[str, TableContract] = {c.name: c for c in (
    CUSTOMERS, SELLERS, PRODUCTS, CATEGORY_TRANSLATION, ORDERS, ORDER_ITEMS, ORDER_PAYMENTS,
    ORDER_REVIEWS, GEOLOCATION, QUALIFIED_LEADS, CLOSED_DEALS, FUEL_PRICES, WEATHER_DAILY,
    MUNICIPALITIES, MUNICIPALITY_POPULATION, MUNICIPALITY_GDP, MUNICIPALITY_BUSINESS,
)}
CONFORMED: Mapping[str, TableContract] = {c.name: c for c in (
    SILVER_CUSTOMERS, SILVER_SELLERS, SILVER_CATEGORY_TRANSLATION, SILVER_PRODUCTS,
    SILVER_ORDERS, SILVER_ORDER_ITEMS,
)}


def source_columns(contract: TableContract) -> tuple[str, ...]:
    """The columns a landed snapshot's files must have."""
    return tuple(c.name for c in contract.columns if c.name != "source_file")
