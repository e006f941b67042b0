from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.neardup import near_duplicates


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_minhash_neardup": op5_minhash_neardup}
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
SQL = {
    "op5_minhash_neardup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT e.y, reach.r FROM reach JOIN both_ways e ON e.x = reach.node AND reach.r < e.y),
comp AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.node = d.doc_id"""
}
