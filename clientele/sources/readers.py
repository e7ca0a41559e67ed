"""Commerce readers: CSV files with explicit schemas, or column-pruned Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.sources import contracts as C


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def translate_categories(products: DataFrame, translation: DataFrame | None) -> DataFrame:
    """English category where one is known, else the original. The translation keeps one row per name."""
    if translation is None:
        return products
    names = translation.dropDuplicates(["product_category_name"])
    joined = products.join(names, "product_category_name", "left")
    return joined.withColumn(
        "category_english", C.category_name("product_category_name", "product_category_name_english")
    )


def read_commerce_csv(spark: SparkSession, root: str, pattern: str = "{name}.csv") -> dict[str, DataFrame]:
    """Nine tables from CSV. A missing required file raises, a missing optional one reads as empty."""
    tables: dict[str, DataFrame] = {}
    for name, schema in C.RAW_SCHEMAS.items():
        path = f"{root.rstrip('/')}/{pattern.format(name=name)}"
        if _exists(spark, path):
            df = (
                spark.read.schema(schema)
                .option("header", True)
                .option("multiLine", name == "reviews")
                .option("escape", '"')
                .csv(path)
            )
        elif name in C.OPTIONAL_TABLES:
            df = C.empty(spark, schema)
        else:
            raise FileNotFoundError(f"required file {path} is missing")
        tables[name] = C.coerce_datetimes(df, C.DATETIME_COLUMNS.get(name, ()))
    if _exists(spark, f"{root.rstrip('/')}/{pattern.format(name='category_translation')}"):
        tables["products"] = translate_categories(tables["products"], tables["category_translation"])
    return tables


# The columns the cutoff-gated labels and features need.
LEAN_COLUMNS = {
    "customers": ("customer_id", "customer_unique_id", "customer_city", "customer_state"),
    "orders": ("order_id", "customer_id", "order_status", "order_purchase_timestamp"),
    "order_items": ("order_id", "product_id", "price", "freight_value"),
    "products": ("product_id", "product_category_name"),
}


def lean(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only the four tables and columns the label operators use; the scan reads no others."""
    return {name: tables[name].select(*cols) for name, cols in LEAN_COLUMNS.items()}


def load_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts, distinct customers and date range of a load as ``(item, value)`` rows."""
    orders, customers = tables["orders"], tables["customers"]
    counts = [
        ("orders", orders.agg(F.count(F.lit(1)).cast("string"))),
        ("customers", customers.agg(F.countDistinct("customer_unique_id").cast("string"))),
        ("products", tables["products"].agg(F.count(F.lit(1)).cast("string"))),
        ("sellers", tables["sellers"].agg(F.count(F.lit(1)).cast("string"))),
        ("first_order", orders.agg(F.min(F.to_date("order_purchase_timestamp")).cast("string"))),
        ("last_order", orders.agg(F.max(F.to_date("order_purchase_timestamp")).cast("string"))),
    ]
    out = None
    for name, frame in counts:
        row = frame.toDF("value").select(F.lit(name).alias("item"), "value")
        out = row if out is None else out.unionByName(row)
    status = orders.groupBy("order_status").agg(F.count(F.lit(1)).cast("string").alias("value"))
    return out.unionByName(status.select(F.concat(F.lit("status:"), "order_status").alias("item"), "value"))


def expected_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Each expected file below ``root`` with its size; a missing or empty one is not ``ok``."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(F.col("path"), F.col("length"))
    )
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    # a name is the first part below the folder, be it a file or a folder of part files
    below = F.substring("path", len(base.rstrip("/")) + 2, 1 << 20)
    listing = listing.withColumn("name", F.element_at(F.split(below, "/"), 1))
    sized = (
        wanted.join(listing, "name", "left")
        .groupBy("name")
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    )
    return sized.withColumn("ok", F.col("bytes") > 0)
