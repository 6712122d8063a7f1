"""Sources of documents: agreements rendered from the order tables, text files, taxonomies, and sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.functions.text import slug, strip, without_label

#: One agreement for each order, in SQL that Spark and DuckDB read alike. Lines come and go with the order's key, so that every kind
#: of line that the operators look for occurs, and does not occur, in many documents.
CONTRACTS_SQL = """
SELECT o_orderkey AS doc_id, concat_ws(chr(10),
  'SUPPLY AGREEMENT',
  CASE WHEN o_orderkey % 7 = 0 THEN 'ARTICLE IV DEFINITIONS' END,
  concat('This agreement is made between ', c_name, ' of ', n_name, ' and the Supplier', CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE ' named' END),
  CASE WHEN o_orderkey % 2 = 1 THEN 'below, subject to the terms that follow.' END,
  '',
  '1. PAYMENT TERMS',
  concat('1.1 The Customer shall pay ', CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR(40)), ' by ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(40)), '.', CASE WHEN o_orderkey % 3 = 0 THEN concat('   ', chr(13)) ELSE '' END),
  CASE WHEN o_orderkey % 4 = 0 THEN concat('- ', CAST(o_orderkey % 30 + 1 AS VARCHAR(10)), ' -') END,
  CASE WHEN o_orderkey % 5 < 3 THEN 'The Supplier may charge any fee it sees fit, unless the law says other' END,
  CASE WHEN o_orderkey % 5 < 3 THEN concat('wise.', chr(160), 'Such fees', chr(9), 'are final and  not refundable.') END,
  CASE WHEN o_orderkey % 6 = 1 THEN concat('Page - ', CAST(o_orderkey % 9 + 1 AS VARCHAR(10)), ' - The invoice address is above.') END,
  'SECTION 2 - DELIVERY',
  'The goods consist of the following:',
  '- goods ordered under this agreement,',
  CASE WHEN o_orderkey % 3 = 1 THEN '  that are in stock' END,
  '- spare parts; and',
  '(3) manuals for each of them.',
  CASE WHEN o_orderkey % 8 < 3 THEN concat('■ Delivery is late if it comes after the date above', chr(7), 'except where both agree.') END,
  CASE WHEN o_orderkey % 9 = 4 THEN concat(chr(10), chr(10), chr(10)) END,
  concat(CAST(o_orderkey % 4 + 3 AS VARCHAR(10)), ') Termination'),
  CASE WHEN o_orderkey % 4 < 2 THEN 'The Supplier may terminate this agreement at any time for convenience without notice. No compensation is due to the Customer in that case. It may do so more than once.' END,
  CASE WHEN o_orderkey % 4 >= 2 THEN 'Either party may terminate this agreement with 30 days written notice as required by the Consumer Rights Act 2015, sections 62-68.' END,
  CASE WHEN o_orderkey % 10 < 4 THEN 'Notwithstanding clause 1, the liability of the Customer is unlimited and without any cap.' END,
  CASE WHEN o_orderkey % 11 < 5 THEN 'Audit Rights And Records' END,
  CASE WHEN o_orderkey % 11 < 5 THEN concat('The Supplier may audit the books of the Customer at any time & "inspect" the premises <without notice> provided that it pays.') END,
  'Clause 9 Governing Law',
  CASE o_orderkey % 3 WHEN 0 THEN 'The law of England governs.' WHEN 1 THEN 'The courts decide under the Housing Act 1988 and common law on penalties' ELSE 'Disputes go to arbitration, and the loser pays, and costs follow.' END,
  CASE WHEN o_orderkey % 2 = 0 THEN 'By: /s/ Jane Poe' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Jane Poe, President' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Date: 01/02/1998' END,
  CASE WHEN o_orderkey % 5 = 1 THEN '12 March 1998' END,
  CASE WHEN o_orderkey % 7 = 3 THEN 'Attn: Legal Department' END,
  CASE WHEN o_orderkey % 7 = 4 THEN 'Northfield, Illinois 60093' END
) AS text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


#: Agreements that a task renders; their lines, about 20 each, are what it sorts at once.
DOCS_PER_TASK = 10_000


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the rendered agreements.

    The few columns that a text is made of are dealt by document before it is rendered. So no text is moved for what is done by
    document afterwards, lines and findings of a document meet without another exchange, and small tables keep every core busy. They
    are put in order while they are few columns: lines come in order of document and number, which later sorts find in place.
    """
    orders, customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    # what is dealt by document alone may also meet by document and line
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // DOCS_PER_TASK))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    dealt = joined.select("o_orderkey", "o_totalprice", "o_orderdate", "c_name", "n_name").repartition(parts, "o_orderkey").sortWithinPartitions("o_orderkey")
    return spark.sql(CONTRACTS_SQL[: CONTRACTS_SQL.index("FROM orders")] + "FROM {dealt}", dealt=dealt)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files: doc_id (a hash of the path), path, size, modified, text."""
    files = spark.read.option("wholetext", True).text(path)
    meta = F.col("_metadata")
    return files.select(F.sha2(meta["file_path"], 256).alias("doc_id"), meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), F.col("value").alias("text"))


def taxonomy_of(rows: DataFrame) -> DataFrame:
    """id, name, description from rows of either kind: id/name/description, or Category .../Description with labels in the cells.

    Headers may carry a byte order mark or blanks. Rows without a name leave, ids that are missing are made from the name, and ids
    met before get _2, _3, in row order.
    """
    names = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    pick = lambda c: F.col(f"`{names[c]}`") if c in names else F.lit("")
    seen = rows.select(*rows.columns, F.monotonically_increasing_id().alias("__row"))
    if "id" in names and "name" in names:
        base = seen.select("__row", strip(pick("id")).alias("id"), strip(pick("name")).alias("name"), without_label(pick("description"), "description").alias("description"))
        base = base.withColumn("id", F.when(F.col("id") == "", slug(F.col("name"))).otherwise(F.col("id")))
    else:
        label = next((c for c in names if c.startswith("category")), "category")
        base = seen.select("__row", without_label(pick(label), "category").alias("name"), without_label(pick("description"), "description").alias("description"))
        base = base.withColumn("id", slug(F.col("name")))
    return unique_ids(base.filter("name <> ''"), "__row").select("id", "name", "description")


def unique_ids(rows: DataFrame, order: str) -> DataFrame:
    """The first row of an id keeps it, later ones get _2, _3."""
    at = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return rows.withColumn("__at", at).withColumn("id", F.when(F.col("__at") == 1, F.col("id")).otherwise(F.concat_ws("_", "id", "__at"))).drop("__at")


def read_taxonomy_csv(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy_of(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def read_taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """id, name, description of a {version, categories, source} file."""
    return spark.read.json(path, multiLine=True).select(F.inline("categories")).select("id", "name", "description")


def read_taxonomy(spark: SparkSession, csv_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """The CSV taxonomy where there is one, else the JSON one; without either an error. Neither file is written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path, read in ((csv_path, read_taxonomy_csv), (json_path, read_taxonomy_json)):
        if path:
            at = hadoop.Path(path)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                return read(spark, path)
    raise FileNotFoundError(f"no taxonomy at {[p for p in (csv_path, json_path) if p]}")


def write_taxonomy_json(taxonomy: DataFrame, path: str, *, version: str = "1", source: str = "") -> None:
    """One {version, categories, source} object in a folder, as read_taxonomy_json() takes it; categories in row order. A taxonomy is small."""
    categories = F.collect_list(F.struct("id", "name", F.coalesce("description", F.lit("")).alias("description"))).alias("categories")
    whole = taxonomy.coalesce(1).agg(categories).select(F.lit(version).alias("version"), "categories", F.lit(source).alias("source"))
    whole.write.mode("overwrite").json(path)


def citations(*named: DataFrame) -> DataFrame:
    """name: the names of all tables (name), stripped, each once, in order; null and empty ones leave."""
    every = named[0].select("name")
    for more in named[1:]:
        every = every.union(more.select("name"))
    return every.select(strip(F.col("name")).alias("name")).filter("name <> ''").distinct().orderBy("name")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line for each document, in a folder for each doc_id's hash bucket, so that one document is read without the rest."""
    results.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(64))).write.mode("overwrite").partitionBy("bucket").json(path)
