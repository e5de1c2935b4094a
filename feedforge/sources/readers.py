"""Sources of articles, behaviors, histories and vectors, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.functions import text as X
from feedforge.functions.lists import binary_labels, pad_left, tail

# Column names of the published files.
NEWS = "news_id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"
BEHAVIORS = "impression_id string, user_id string, time string, history string, impressions string"
OPTIONAL = ["last_modified_time", "total_inviews", "total_pageviews", "total_read_time", "premium", "article_type", "sentiment_score", "sentiment_label"]


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", "false").csv(path)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Articles from tab-separated news: empty abstracts are null, entities come from JSON."""
    raw = _tsv(spark, path, NEWS)
    te, ae = F.col("title_entities"), F.col("abstract_entities")
    return raw.select(
        F.col("news_id").alias("article_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.nullif("abstract", F.lit("")).alias("abstract"),
        F.lit(None).cast("string").alias("body"),
        "category",
        "subcategory",
        F.lit(None).cast("timestamp").alias("published_time"),
        "url",
        X.entity_forms(te, ae).alias("entities"),
        X.entity_ids(te, ae).alias("entity_ids"),
    )


def read_behaviors(spark: SparkSession, path: str) -> DataFrame:
    """Impressions from tab-separated behaviors; rows whose time fits neither format go."""
    raw = _tsv(spark, path, BEHAVIORS)
    parsed = raw.withColumn("impression_time", X.two_format_time(F.col("time"))).filter("impression_time is not null").withColumn("__i", X.impression_tokens(F.col("impressions")))
    return parsed.select(
        "impression_id",
        "user_id",
        "impression_time",
        X.words_or_empty(F.col("history")).alias("history"),
        F.transform("__i", lambda z: z["id"]).alias("inview"),
        F.transform("__i", lambda z: z["label"]).alias("labels"),
    )


def dropped_times(spark: SparkSession, path: str) -> DataFrame:
    """One row: behaviors whose time could not be read."""
    return _tsv(spark, path, BEHAVIORS).agg(F.count_if(X.two_format_time(F.col("time")).isNull()).alias("n_dropped"))


def read_entity_vectors(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, vector from lines of an id and numbers, parted by white space; blank lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(parts[0].alias("entity_id"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vector"))


def normalize_articles(raw: DataFrame) -> DataFrame:
    """Articles from a table with other names and types; optional columns stay where they exist."""
    kinds, empty = dict(raw.dtypes), F.array().cast("array<string>")
    have = lambda c, kind="string": F.col(c).cast(kind) if c in kinds else F.lit(None).cast(kind)
    strings = lambda c: F.transform(F.col(c), lambda x: x.cast("string")) if c in kinds else empty
    return raw.select(
        F.col("article_id").cast("string").alias("article_id"),
        F.coalesce(have("title"), F.lit("")).alias("title"),
        F.coalesce(have("subtitle"), have("abstract"), F.lit("")).alias("abstract"),
        F.coalesce(have("body"), F.lit("")).alias("body"),
        F.coalesce(have("category_str"), have("category")).alias("category"),
        F.nullif(F.array_join(strings("subcategory"), ", "), F.lit("")).alias("subcategory"),
        have("published_time", "timestamp").alias("published_time"),
        have("url").alias("url"),
        F.coalesce(strings("entity_groups"), empty).alias("entities"),
        F.coalesce(strings("ner_clusters"), empty).alias("entity_ids"),
        *[c for c in OPTIONAL if c in kinds],
    )


def normalize_behaviors(raw: DataFrame) -> DataFrame:
    """Impressions from lists of shown and clicked ids; an empty list shown gives an empty label list."""
    shown = F.transform("article_ids_inview", lambda x: x.cast("string"))
    clicked = F.coalesce(F.transform("article_ids_clicked", lambda x: x.cast("string")), F.array().cast("array<string>"))
    extra = [c for c in ("device_type", "is_sso_user", "is_subscriber", "gender", "age") if c in raw.columns]
    ids = [F.col(c).cast("string").alias(c) for c in ("impression_id", "user_id")]
    return raw.select(*ids, "impression_time", shown.alias("inview"), binary_labels(shown, clicked).alias("labels"), *extra)


def click_log(histories: DataFrame) -> DataFrame:
    """A row for each click of per-user lists of equal lengths; seq keeps the order of the log."""
    z = F.arrays_zip("impression_time_fixed", "article_id_fixed", "read_time_fixed")
    each = histories.select(F.col("user_id").cast("string").alias("user_id"), F.posexplode(z).alias("seq", "z"))
    return each.select("user_id", "seq", F.col("z")["impression_time_fixed"].alias("click_time"), F.col("z")["article_id_fixed"].cast("string").alias("article_id"), F.col("z")["read_time_fixed"].cast("float").alias("read_time"))


def behaviors_with_history(spark: SparkSession, folder: str, size: int = 30, padding: int | None = 0) -> DataFrame:
    """Behaviors joined with the last `size` clicks of their users, padded on the left on request."""
    last = pad_left(F.col("article_id_fixed"), size, F.lit(padding)) if padding is not None else tail(F.col("article_id_fixed"), size)
    history = spark.read.parquet(f"{folder}/history.parquet").select("user_id", last.alias("article_id_fixed"))
    return spark.read.parquet(f"{folder}/behaviors.parquet").join(history, "user_id", "left")


def read_vectors(spark: SparkSession, path: str, key: str = "article_id") -> DataFrame:
    """Vectors of a table: the column document_vector, else the last one; null keys and vectors go."""
    raw = spark.read.parquet(path)
    column = "document_vector" if "document_vector" in raw.columns else raw.columns[-1]
    return raw.select(F.col(key).cast("string").alias(key), F.col(column).cast("array<float>").alias("vector")).dropna()


def join_vectors(df: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Left join with vectors that were first reduced to the keys in question."""
    return df.join(vectors.join(df.select(key).distinct(), key, "left_semi"), key, "left")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """impression_id, ranks from lines of a name, white space or a comma, and a list in brackets."""
    line = r"^([^\s,]+)[\s,]+(\[.*\])$"
    return spark.read.text(path).select(F.regexp_extract("value", line, 1).alias("impression_id"), F.from_json(F.regexp_extract("value", line, 2), "array<double>").alias("ranks"))
