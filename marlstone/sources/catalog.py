"""Catalogue, query and few-shot readers, with explicit schemas, and the index sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.routing import contains_any
from ..ordering import ranged, shifts
from ..session import materialise

CATEGORIES = ["clean", "household", "cleaning", "deterg", "dish", "laundry", "polish", "wipe", "disinfect", "bath"]
PRODUCTS = "doc_id string, sku string, asin string, title string, brand string, category string, price double, list_price double, rating double, features array<string>, ingredients string, size_oz double, price_per_oz double, url string, stock string"
REVIEWS = "product_id string, stars double, snippet string, ord long"
GOLD = "id string, query string, filters struct<price_max:double,price_min:double,min_rating:double,brand:string,material:string,category_contains:string>, relevant_skus array<string>, notes string"


def raw_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as text, blanks as '', and header names trimmed; `_ord` follows the file."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    return rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns]).withColumn("_ord", F.monotonically_increasing_id())


def catalog_slice(raw: DataFrame, keywords: list[str] = CATEGORIES, column: str = "Category") -> DataFrame:
    """Rows of the wanted categories; all rows if there are none, or no such column."""
    if column not in raw.columns:
        return raw
    hit = contains_any(F.lower(F.col(column)), keywords)
    return raw.filter(hit | ~F.coalesce(raw.agg(F.bool_or(hit)).scalar(), F.lit(False)))


def with_ids(raw: DataFrame) -> DataFrame:
    """One id for products and reviews: the unique id, else the ASIN, else the row's number in the slice.

    Rows are numbered within partitions of their order, written once, and shifted by what the
    partitions before hold, so that both tables read the same numbers."""
    if "_id" in raw.columns:
        return raw
    rows = ranged(raw, ["_ord"], "catalog")
    shift = materialise(shifts(rows, [], F.lit(1)), "shifts")  # a row for each partition
    number = F.col("_before") + F.col("_row")
    numbered = rows.join(F.broadcast(shift), "_part").withColumn("_number", F.lpad(number.cast("string"), 5, "0")).drop("_part", "_row", "_before")
    asin = F.coalesce(F.nullif(F.trim("Asin"), F.lit("")), F.concat(F.lit("ROW"), "_number"))
    return numbered.withColumn("_asin", asin).withColumn("_id", F.coalesce(F.nullif(F.trim("Uniq Id"), F.lit("")), F.col("_asin")))


def _column(raw: DataFrame, name: str):
    return F.col(f"`{name}`") if name in raw.columns else F.lit("")


def products(raw: DataFrame) -> DataFrame:
    rows, c = with_ids(raw), lambda n: F.trim(_column(raw, n))
    price = F.coalesce(T.parse_price(c("Selling Price")), T.parse_price(c("List Price")))
    size = T.parse_size_oz(c("Size Quantity Variant"), c("Product Name"), c("About Product"))
    return rows.select(
        F.col("_id").alias("doc_id"), F.coalesce(F.nullif(c("Sku"), F.lit("")), F.col("_asin")).alias("sku"), F.col("_asin").alias("asin"), c("Product Name").alias("title"),
        c("Brand Name").alias("brand"), c("Category").alias("category"), price.alias("price"), T.parse_price(c("List Price")).alias("list_price"), T.parse_rating(c("Rating")).alias("rating"),
        T.split_features(c("About Product")).alias("features"), T.clean_ingredients(c("Ingredients")).alias("ingredients"), size.alias("size_oz"), T.price_per_oz(price, size).alias("price_per_oz"),
        c("Product Url").alias("url"), c("Stock").alias("stock"),
    ).filter("title <> ''")


def reviews(raw: DataFrame) -> DataFrame:
    """One row for each snippet; a typed empty frame if the catalogue has none."""
    if "Review Snippets" not in raw.columns:
        return raw.sparkSession.createDataFrame([], REVIEWS)
    rows = with_ids(raw)
    own = rows.select(F.col("_id").alias("product_id"), T.parse_rating(_column(rows, "Rating")).alias("stars"), "Review Snippets")
    return exploded(own, "Review Snippets", r"\|\|").select("product_id", "stars", "snippet", "ord")


def exploded(rows: DataFrame, column: str, delimiter: str) -> DataFrame:
    """rows with a row for each part of a text column that isn't blank: snippet, and ord from 0."""
    parts = F.filter(F.transform(F.split(column, delimiter), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("*", F.posexplode(parts).alias("ord", "snippet")).withColumn("ord", F.col("ord").cast("long")).drop(column)


def ingest(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Write both tables and return the summary of what was read."""
    raw = materialise(raw_catalog(spark, path), "raw")  # a file with rows of several lines is read by one task, so once
    sliced = with_ids(catalog_slice(raw))
    products(sliced).write.mode("overwrite").parquet(f"{out}/products")
    reviews(sliced).write.mode("overwrite").parquet(f"{out}/reviews")
    p, r = load(spark, out)
    counts = p.agg(F.count(F.lit(1)).alias("n_products"), F.count("price").alias("with_price"), F.count("rating").alias("with_rating"), F.count_if(F.col("ingredients") != "").alias("with_ingredients"))
    return counts.withColumns({"n_raw": F.lit(raw.count()), "n_slice": F.lit(sliced.count()), "n_reviews": F.lit(r.count())})


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Products and reviews; reviews are empty where there is no such table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/reviews")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    found = spark.read.schema(REVIEWS).parquet(f"{folder}/reviews") if there else spark.createDataFrame([], REVIEWS)
    return spark.read.schema(PRODUCTS).parquet(f"{folder}/products"), found


def index_documents(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Products with the text to index: the first three snippets of each come along."""
    order = Window.partitionBy("product_id").orderBy("ord")
    top = reviewed.withColumn("_n", F.row_number().over(order)).filter("_n <= 3")
    held = top.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    rows = found.join(held, found["doc_id"] == held["product_id"], "left").drop("product_id")
    text = T.embed_text(F.col("title"), F.col("brand"), F.col("features"), F.col("ingredients"), F.coalesce("snippets", F.array().cast("array<string>")))
    return rows.withColumn("material", T.material_tag(F.col("title"), F.col("category"))).withColumn("text", text).drop("snippets")


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path).filter("id is not null")


def few_shots(spark: SparkSession, path: str) -> list[dict]:
    """A whole-file JSON list of examples."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def audio_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files by name, without their bytes unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    clips = files.filter(F.regexp_like(F.lower(name), F.lit(r"^query.*\.(wav|mp3|m4a|flac|ogg|webm)$")))
    query, speaker = T.audio_name(name)
    return clips.select("path", "length", query.alias("query"), speaker.alias("speaker")).orderBy("path")


def prompt(spark: SparkSession, path: str) -> str:
    """A prompt file's whole text, read anew on each call; blanks at its ends go."""
    return spark.read.text(path, wholetext=True).first()[0].strip()
