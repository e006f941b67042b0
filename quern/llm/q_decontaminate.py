from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import decontaminate


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, bench)
    r = "decontamination"
    return out.select(
        "doc_id", F.col(f"{r}.n_words").alias("n_words"), F.col(f"{r}.n_hit").alias("n_hit"), F.size(f"{r}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{r}.items", ","), 256).alias("items_sha256"), F.col(f"{r}.contaminated").alias("contaminated"),
    )


QUERIES = {"op8_decontamination": op8_decontamination}

_WORDS = r"""regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = {
    "op8_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, dw.n, s, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
}
