"""Reading the input tables, as batches and as streams, and text derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.sources.session import asked_spread, is_folder, several_a_core, spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are about to be searched, dealt out if the session asks for it."""
    return spread(table(spark, sf_dir, name), asked_spread(spark))


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same table as a file stream: a folder of files, or a single one told by its name."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


#: how texts with quotes and line breaks are written to csv files, and read from them
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Texts from ``parquet``, ``json``, ``csv`` (as :data:`CSV`), ``orc`` or ``text`` files."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.options(**(CSV if fmt == "csv" else {})).format(fmt).load(path)


def stream_texts(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """The same files as a stream, which has to be told the schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**(CSV if fmt == "csv" else {})).format(fmt).load(path)


def write_mapping(mapping: DataFrame, path: str, scope: str) -> None:
    """Store a mapping apart from the masked texts: it is as sensitive as they were.
    Clustered by scope so that a later restore reads few row groups."""
    mapping.sortWithinPartitions(scope, "placeholder").write.mode("overwrite").parquet(path)


# One service note per order, written out of the columns of orders and customer. The
# prose of `documents` triggers few detectors; these notes trigger all of them, on
# as many rows as there are orders. Plain SQL that Spark and DuckDB read alike.
ORDER_NOTES_SQL = """
WITH keyed AS (
  SELECT o_orderkey AS k, o_custkey AS c, c_name, c_nationkey AS n,
    lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') AS k4,
    lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') AS k3,
    lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') AS k2,
    lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') AS c3,
    lpad(CAST(o_custkey % 100 AS STRING), 2, '0') AS c2,
    CAST(1 + o_orderkey % 9 AS STRING) AS d1,
    CASE o_custkey % 6 WHEN 0 THEN 'Jean Dupont' WHEN 1 THEN 'Marie de la Tour'
      WHEN 2 THEN 'Anna von Berg' WHEN 3 THEN 'John Smith' WHEN 4 THEN 'Paul Le Gall'
      ELSE 'New York' END AS who,
    CASE o_custkey % 5 WHEN 0 THEN 'Acme Solutions' WHEN 1 THEN 'Blue River Group'
      WHEN 2 THEN 'Nord Tech International' WHEN 3 THEN 'Duval SARL'
      ELSE 'Plain Words Only' END AS firm
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
)
SELECT k AS note_id, c AS custkey, CASE k % 10
  WHEN 0 THEN 'Order REF-2024-' || k3 || ' of ' || c_name || ', mail user' || CAST(c AS STRING)
    || '@mail' || CAST(n AS STRING) || '.example.com or USER' || CAST(c AS STRING) || '@mail'
    || CAST(n AS STRING) || '.example.com, paid EUR ' || CAST(k % 900 + 100 AS STRING)
    || '.50 and 12 ' || k3 || ' EUR, follow @cust_' || c3 || ' x'
  WHEN 1 THEN 'Card 4111 ' || k4 || ' 1111 ' || k4 || ' CVV: ' || k3 || ' exp 0' || d1 || '/27 or expiry : 10/2028'
    || ' then 12/0' || d1 || '/2024; call +33 6 ' || k2 || ' ' || c2 || ' ' || k2 || ' ' || c2
    || ' ou 06.' || k2 || '.' || c2 || '.' || k2 || '.' || c2
  WHEN 2 THEN 'IBAN FR76 3000 6000 0112 3456 ' || k4 || ' 189 BIC AGRIFRPP' || ' Banque : 30006 , Guichet : 0'
    || k4 || ' , Compte : 1234567' || k4 || ' , Clé : ' || k2
  WHEN 3 THEN 'NIR 1 84 12 75 ' || k3 || ' ' || c3 || ' 42, SIRET ' || k3 || ' ' || c3 || ' 045 00018, SIREN ' || k3
    || '-303-' || c3 || ', VAT FR40 303' || k3 || '045, SSN ' || k3 || '-' || c2 || '-' || k4
  WHEN 4 THEN d1 || ' bis rue de la Paix, 75' || k3 || ' Paris. ' || CAST(k % 900 + 1 AS STRING)
    || ' Fifth Avenue, New York, NY 1' || k4 || ' then ZIP 1' || k4 || '-0001'
  WHEN 5 THEN '😀 host 10.0.' || CAST(k % 256 AS STRING) || '.' || CAST(c % 256 AS STRING) || ' fe80:0:0:0:0:0:0:'
    || CAST(k % 10 AS STRING) || ' aa:bb:cc:dd:ee:' || k2 || ' see https://shop' || c3 || '.example/x?y=' || k3
    || ') and http://a.example/0' || k4 || '12345 @joe_' || c3
  WHEN 6 THEN 'Née le 3 août 19' || k2 || ', born March 4th, 19' || c2 || ', le 1er janvier 20' || k2
    || ', on 2024-0' || d1 || '-12 or September 3rd, 2024 or 31/1/20' || c2
  WHEN 7 THEN 'sk-ant-api03-abcdefghijklmnopq' || k4 || '_x AKIAABCDEFGHIJ' || k4 || 'ZQ eyJhbGci' || k4 || '.eyJzdWIi.sig_'
    || c3 || ' Bearer abcdefgh' || k4 || '= password: hunter' || k4 || ' mot de passe = x' || c3
  WHEN 8 THEN 'Mr ' || who || ' of ' || firm || ' earns about ' || c2 || ' 000 € par an, gets $1,2' || k2 || '.50 and $' || c2
    || 'k. Dr ' || who || ' too. AB12CD34' || k4
  ELSE 'Bonjour ' || who || ', passport n° US X' || k4 || '567, driver''s license: D' || k3 || '-456-789. Contact '
    || who || ' at ' || firm || ' ref ' || CAST(k AS STRING) || '-ABC_' || k4
  END AS text
FROM keyed
"""


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``note_id, custkey, text``: one note per order.

    Rows of orders are short and the search of a note takes long, so the split of the scan, by
    bytes and row groups, and that of the join say nothing about the work: a million orders
    would be one task. The notes are dealt out by their id, to several tasks a core.
    """
    notes = spark.sql(ORDER_NOTES_SQL, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    return notes.repartition(asked_spread(spark) or several_a_core(spark), "note_id")


def order_notes_sql() -> str:
    return ORDER_NOTES_SQL.format(orders="orders", customer="customer")
