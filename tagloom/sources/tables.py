"""The tables of the data model: typed loaders, definitions, views and a catalogue probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of each table.
SCHEMAS = {
    "userlj": "id long, nick string, region_id long, created timestamp_ntz, updated timestamp_ntz, fetched timestamp_ntz,"
    " birthday date, interests string, city_cstm string, posts_num int, cmmnt_in int, cmmnt_out int, bio string",
    "post": "id long, url long, user_id long, date timestamp_ntz, title string, text string, normalized boolean,"
    " comments int, normalizer_id int",
    "mastertag": "id long, text string",
    "tag": "id long, text string, master_id long, text_norm string",
    "tagtopost": "tag_id long, post_id long",
    "unigram": "id long, text string",
    "unigramtopost": "ngram_id long, post_id long, uses_str string, uses_cnt int",
    "tfidfsimple": "tag_id long, type int, ngram_id long, tf double, idf double, tf_idf double",
}
#: Views over them: lengths and different words of normalized posts, tags by name, free posts. Repeated postings keep their largest uses.
VIEWS = {
    "posting": "SELECT ngram_id, post_id, max(uses_cnt) AS uses_cnt FROM unigramtopost WHERE ngram_id IS NOT NULL AND post_id IS NOT NULL GROUP BY ngram_id, post_id",
    "post_length": "SELECT post.id AS post_id, coalesce(sum(uses_cnt), 0) AS length FROM post LEFT JOIN posting ON posting.post_id = post.id WHERE normalized GROUP BY post.id",
    "post_unique_word_count": "SELECT post.id AS post_id, count(uses_cnt) AS words FROM post LEFT JOIN posting ON posting.post_id = post.id WHERE normalized GROUP BY post.id",
    "tag_name_to_post": "SELECT DISTINCT text, post_id FROM tagtopost JOIN tag ON tag.id = tag_id WHERE post_id IS NOT NULL",
    "post_to_normalize": "SELECT id FROM post WHERE NOT normalized AND normalizer_id IS NULL",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet`` (a file or a folder of parts); column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def create_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Creates the model's tables in the catalogue where they are missing, empty and of Parquet; drops nothing. Their names."""
    names = [f"{database}.{name}" if database else name for name in SCHEMAS]
    for full, columns in zip(names, SCHEMAS.values(), strict=True):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING parquet")
    return names


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """The folder's tables and the views over them as temporary views of the session. Their names."""
    for name in SCHEMAS:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    return [*SCHEMAS, *VIEWS]


def has_table(spark: SparkSession, name: str) -> bool:
    """Whether the catalogue, temporary views included, has a table of that name."""
    return spark.catalog.tableExists(name)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 20, **options: str) -> DataFrame:
    """A table of a database, read by ranges of a whole-number key side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()
