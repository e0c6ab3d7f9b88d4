"""Normalisation, slicing and document composition over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hybrid
from ..session import materialise
from .common import query, table

RAW_PRICE = "case p_partkey % 6 when 0 then '$ 1,' || lpad(cast(p_partkey % 1000 as varchar(10)), 3, '0') || '.50' when 1 then 'nan' when 2 then ' ' when 3 then 'USD ' || cast(p_size as varchar(10)) || '.25 each' when 4 then '-5.00' else 'about none' end"
RAW_RATING = "case p_partkey % 4 when 0 then '4.6 out of 5' when 1 then '1,000' when 2 then 'NaN' else cast(p_size as varchar(10)) || ' points' end"
RAW_SIZE = "cast(p_size as varchar(10)) || case p_partkey % 5 when 0 then ' Fl. Oz' when 1 then '.5 ml' when 2 then 'lb' when 3 then ' ct' else ' floz' end"
RAW_TITLE = "p_name || case when p_partkey % 3 = 0 then ' 12 oz bottle' else '' end"
NUMBER = r"[-+]?\d[\d,]*\.?\d*"
SIZE = r"(?i)(\d+(?:\.\d+)?)\s*(fl\.?\s*oz|fluid ounce|ounce|oz|ml|milliliter|l\b|liter|lb|pound|g\b|gram)"
PRESENT = "case when lower(trim({0})) not in ('', 'nan', 'none') then trim({0}) end"


def sql_price(x: str) -> str:
    n = f"try_cast(nullif(regexp_extract(replace({PRESENT.format(x)}, ',', ''), '{NUMBER}'), '') as double)"
    return f"case when {n} > 0 then {n} end"


def sql_size(x: str) -> str:
    unit = f"replace(lower(regexp_extract({x}, '{SIZE}', 2)), '.', '')"
    factor = f"case {unit} " + " ".join(f"when '{u}' then {v!r}::double" for u, v in T.OUNCES.items()) + " end"
    return f"round(try_cast(nullif(regexp_extract({x}, '{SIZE}', 1), '') as double) * {factor}, 3)"


@query(f"select p_partkey, raw, {sql_price('raw')} as price from (select p_partkey, {RAW_PRICE} as raw from part)")
def etl_parse_price(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(RAW_PRICE).alias("raw")).withColumn("price", T.parse_price(F.col("raw")))


_R = f"try_cast(nullif(regexp_extract({PRESENT.format('raw')}, '{NUMBER}'), '') as double)"


@query(f"select p_partkey, case when {_R} > 0 and {_R} <= 5 then {_R} end as rating from (select p_partkey, {RAW_RATING} as raw from part)")
def etl_parse_rating(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.parse_rating(F.expr(RAW_RATING)).alias("rating"))


@query(f"""select p_partkey, size_oz, case when size_oz > 0 and p_retailprice <> 0 then round(p_retailprice / size_oz, 4) end as price_per_oz
from (select p_partkey, p_retailprice, coalesce({sql_size(f"({RAW_SIZE})")}, {sql_size(f"({RAW_TITLE})")}) as size_oz from part)""")
def etl_size_ppo(spark, d) -> DataFrame:
    sized = table(spark, d, "part").select("p_partkey", "p_retailprice", T.parse_size_oz(F.expr(RAW_SIZE), F.expr(RAW_TITLE)).alias("size_oz"))
    return sized.select("p_partkey", "size_oz", T.price_per_oz(F.col("p_retailprice"), F.col("size_oz")).alias("price_per_oz"))


@query("""select doc_id, len(f)::bigint as n_features, array_to_string(f, '; ') as features from (select doc_id, list_filter(list_transform(
string_split(text, chr(10)), lambda x: trim(x, ' •-' || chr(9))), lambda x: x <> '' and not starts_with(lower(x), 'the ')) as f from documents)""")
def etl_split_features(spark, d) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", T.split_features(F.col("text"), "\n", "the ").alias("f"))
    return parts.select("doc_id", F.size("f").cast("long").alias("n_features"), F.array_join("f", "; ").alias("features"))


def category_slice(rows: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    from ..sources.catalog import catalog_slice

    return catalog_slice(rows, keywords, column)


@query("select p_partkey, p_type from part where lower(p_type) like '%promo%' or lower(p_type) like '%econ%'")
def etl_category_slice(spark, d) -> DataFrame:
    return category_slice(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["promo", "econ"])


@query("select p_partkey, p_type from part")
def etl_category_slice_fallback(spark, d) -> DataFrame:
    return category_slice(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["laundry", "grout"])


NOUNS = ["bolt", "gear", "ring", "old", "plate"]


@query("select p_partkey, case " + " ".join(f"when contains(lower(p_name || ' ' || p_type), '{n}') then '{n}'" for n in NOUNS) + " end as material from part")
def etl_material_tag(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.material_tag(F.col("p_name"), F.col("p_type"), NOUNS).alias("material"))


_SNIPPETS = "select conv_id, turn, unnest(s) as snippet, generate_subscripts(s, 1)::bigint as pos from (select conv_id, turn, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '') as s from conversations)"


def snippets(spark, d, delimiter: str = r"\. ") -> DataFrame:
    from ..sources.catalog import exploded

    return exploded(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", delimiter).select("conv_id", "turn", (F.col("ord") + 1).cast("long").alias("pos"), "snippet")


@query(f"select conv_id, turn, snippet, pos from ({_SNIPPETS})")
def etl_reviews_explode(spark, d) -> DataFrame:
    return snippets(spark, d)


@query(f"""select c.conv_id, coalesce(string_agg(snippet, ' || ' order by turn, pos), '') as snippets from (select distinct conv_id from conversations) c
left join (select *, row_number() over (partition by conv_id order by turn, pos) as n from ({_SNIPPETS})) s on s.conv_id = c.conv_id and n <= 3 group by c.conv_id""")
def etl_top_snippets(spark, d) -> DataFrame:
    top = Window.partitionBy("conv_id").orderBy("turn", "pos")
    best = snippets(spark, d).withColumn("n", F.row_number().over(top)).filter("n <= 3")
    held = best.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "pos", "snippet"))).alias("s"))
    every = table(spark, d, "conversations").select("conv_id").distinct()
    return every.join(held, "conv_id", "left").select("conv_id", F.coalesce(F.array_join(F.col("s.snippet"), " || "), F.lit("")).alias("snippets"))


@query("""select p_partkey, concat_ws(chr(10), nullif(p_name, ''), 'Brand: ' || p_brand, 'Features: ' || p_type || '; size ' || p_size,
case when p_partkey % 4 <> 0 then 'Ingredients: ' || p_type end, 'Reviews: good fine') as document from part""")
def etl_embed_text(spark, d) -> DataFrame:
    ingredients = F.when(F.col("p_partkey") % 4 != 0, F.col("p_type"))
    features = F.array("p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", T.embed_text(F.col("p_name"), F.col("p_brand"), features, ingredients, F.array(F.lit("good"), F.lit("fine"))).alias("document"))


@query("select o_orderkey, o_custkey::varchar || repeat('_dup', (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int) as uid from orders")
def etl_dedupe_ids(spark, d) -> DataFrame:
    from ..sources.index import unique_ids

    return unique_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"]).select("o_orderkey", F.col("store_id").alias("uid"))


@query("select count(*) as n_docs, count(quality) as n_labelled, count(*) filter (where quality = 1) as n_good, count(*) filter (where text <> '') as n_text from documents left join labels using (doc_id)")
def etl_summary(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("text") != "").alias("n_text"))


@query("""select count(*) as n, round(avg((quality is not null)::int), 6) as labelled, round(avg((text <> '')::int), 6) as with_text, round(avg((lang is not null)::int), 6) as with_lang, round(avg((source <> '')::int), 6) as with_source, round(avg((n_chars > 0)::int), 6) as with_size
from documents left join labels using (doc_id)""")
def etl_coverage(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), share(F.col("quality").isNotNull()).alias("labelled"), share(F.col("text") != "").alias("with_text"), share(F.col("lang").isNotNull()).alias("with_lang"), share(F.col("source") != "").alias("with_source"), share(F.col("n_chars") > 0).alias("with_size"))


@query("select min(p_retailprice) as low, median(p_retailprice) as middle, max(p_retailprice) as high from part")
def etl_price_distribution(spark, d) -> DataFrame:
    return table(spark, d, "part").agg(F.min("p_retailprice").alias("low"), F.expr("percentile(p_retailprice, 0.5)").alias("middle"), F.max("p_retailprice").alias("high"))


@query("""select p_partkey, p_name, p_brand, p_retailprice from part where p_retailprice between 0 and 960 and p_retailprice >= 905.5 and lower(p_brand) = 'brand#7' and contains(lower(p_type), 'm')""")
def metadata_filter(spark, d) -> DataFrame:
    keep = hybrid.metadata({"price_max": 960.0, "price_min": 905.5, "brand": "BRAND#7", "category_contains": "M", "unknown": 1}, price="p_retailprice", brand="p_brand", category="p_type")
    return table(spark, d, "part").filter(keep).select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("""select p_partkey, p_name, p_retailprice, row_number() over (order by p_retailprice desc, p_partkey) as n from part
where contains(lower(p_name), 'bolt') and regexp_matches(p_type, '(?i)eco|promo') and p_retailprice < 950""")
def eda_filtered_sort(spark, d) -> DataFrame:
    rows = table(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("bolt")) & F.regexp_like("p_type", F.lit("(?i)eco|promo")) & (F.col("p_retailprice") < 950))
    keys = [F.desc("p_retailprice"), F.col("p_partkey")]
    dealt = rows.select("p_partkey", "p_name", "p_retailprice").repartitionByRange(*keys).sortWithinPartitions(*keys)
    # numbered within range partitions, then shifted by what the partitions before hold
    numbered = materialise(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(shift), "_part").select("p_partkey", "p_name", "p_retailprice", (F.col("_before") + F.col("_row") + 1).alias("n"))


_BROKEN = "case event_id % 5 when 0 then '[1, 2]' when 1 then '{\"k\": ' when 2 then '{\"k\": 1, \"provider\": null}' else props end"
_MISSING = "array_to_string(list_sort(list_filter(['k', 'provider'], lambda x: not list_contains(json_keys(raw), x))), ',')"


@query(f"""select event_id, case when not json_valid(raw) then 'not valid JSON' when json_type(raw) <> 'OBJECT' then 'JSON is not an object' when {_MISSING} <> '' then 'missing required keys: ' || {_MISSING} end as error,
case when json_valid(raw) and json_type(raw) = 'OBJECT' and {_MISSING} = '' then json_extract_string(raw, '$.k') end as k from (select event_id, {_BROKEN} as raw from events)""")
def json_contract_check(spark, d) -> DataFrame:
    """An answer's JSON: an object with all required keys, or what is wrong with it."""
    checked = table(spark, d, "events").select("event_id", T.parsed_object(F.expr(_BROKEN), ["k", "provider"]).alias("c"))
    return checked.select("event_id", "c.error", F.try_variant_get("c.parsed", "$.k", "string").alias("k"))


@query("select doc_id, substr(sha1(text), 1, 12) as content_key, lower(trim(text)) as cache_key from documents")
def content_id(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_key"), T.cache_key(F.col("text")).alias("cache_key"))


@query("select doc_id, case when lower(trim(text)) in ('', 'nan', 'none') then '' else substr(trim(text), 1, 1500) end as ingredients from documents")
def meta_scrub(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring(T.clean_ingredients(F.col("text")), 1, 1500).alias("ingredients"))


_PHRASE = "case p_partkey % 6 when 0 then 'anything under fifteen dollars' when 1 then 'less than $' || cast(p_size as varchar(10)) || '.5 please' when 2 then 'for $ ' || cast(p_size as varchar(10)) when 3 then 'below twelve or under 20' when 4 then 'Under TWENTY' else 'eco friendly ' || p_name end"
_LOW = "lower(phrase)"


@query(f"""select p_partkey, coalesce({', '.join(f"case when regexp_matches({_LOW}, '(under|below|less than)[ ]+{w}') then {float(v)}::double end" for w, v in reversed(T.SPOKEN_NUMBERS.items()))},
try_cast(nullif(regexp_extract({_LOW}, '(?:under|below|less than|<)\\s*\\$?\\s*(\\d+(?:\\.\\d+)?)', 1), '') as double), try_cast(nullif(regexp_extract({_LOW}, '\\$\\s*(\\d+(?:\\.\\d+)?)', 1), '') as double)) as price_max,
contains({_LOW}, 'eco') as eco, case when contains({_LOW}, 'steel') then 'steel' when contains({_LOW}, 'please') then 'please' end as material from (select p_partkey, {_PHRASE} as phrase from part)""")
def price_phrase_router(spark, d) -> DataFrame:
    phrase = F.expr(_PHRASE)
    return table(spark, d, "part").select("p_partkey", T.phrase_price(phrase).alias("price_max"), F.contains(F.lower(phrase), F.lit("eco")).alias("eco"), T.first_term(F.lower(phrase), ["steel", "please"]).alias("material"))
