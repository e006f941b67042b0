from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.urlfilter import host_of, judge, listed, mine, path_of, tokens_of

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def labelled_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(tokens, bad, decided): the verdict of the rule list where it has one, else the label of the document that a page shows.

    A page's url ends in the number of its document; bad: of low quality or toxic.  A document with several labels is bad
    if one of them says so.
    """
    _, verdict = listed(host_of(F.col("url")), path_of(F.col("url")), rules)
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:\.html|/)?(?:[?#]|$)", 1)
    urls = pages.filter("url is not null").select("url", F.when(number != "", number).cast("bigint").alias("doc_id"), (verdict == "block").alias("said"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("marked"))
    return urls.join(marks, "doc_id", "left").select(tokens_of(F.col("url")).alias("tokens"), F.coalesce("said", "marked").alias("bad"), F.col("said").isNotNull().alias("decided")).filter("bad is not null")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(pages, mine(labelled_urls(pages, labels)), RULES)
    return out.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.mined")


QUERIES = {"op3_url_filters": op3_url_filters}
SQL: dict[str, str] = {}
