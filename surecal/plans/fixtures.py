"""Prediction tables derived from the test tables, as SQL that both engines run.

The strings below are used twice: by Spark, with the tables read from a folder, and
as building blocks of the comparison SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Continuous probabilities, over-confident by design. For aggregates, not row keys.
PRED_LINEITEM = """
SELECT l_returnflag AS dataset, l_linestatus AS model,
       CAST(l_linenumber % 3 AS STRING) AS prompt,
       CASE WHEN l_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split,
       CAST((l_orderkey*7919 + l_partkey*104729 + l_linenumber*31) % 10007 AS DOUBLE)
         / CAST(10006 AS DOUBLE) AS y_prob,
       CASE WHEN CAST((l_orderkey*31 + l_suppkey*1777 + l_linenumber*997) % 10009 AS DOUBLE)
                   / CAST(10009 AS DOUBLE)
              < POW(CAST((l_orderkey*7919 + l_partkey*104729 + l_linenumber*31) % 10007 AS DOUBLE)
                   / CAST(10006 AS DOUBLE), 2)
            THEN 1 ELSE 0 END AS y_true
FROM {lineitem}
"""

# 101 distinct probabilities, exactly on bin edges; event_id is a key.
PRED_EVENTS = """
SELECT event_id, event_type AS dataset,
       CASE WHEN user_id % 2 = 0 THEN 'm_small' ELSE 'm_large' END AS model,
       CAST(user_id % 3 AS STRING) AS prompt,
       CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'test' END AS split,
       CAST((event_id*7919 + user_id*104729) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS y_prob,
       CASE WHEN CAST((event_id*31 + user_id*1777) % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE)
              < POW(CAST((event_id*7919 + user_id*104729) % 101 AS DOUBLE) / CAST(100 AS DOUBLE), 2)
            THEN 1 ELSE 0 END AS y_true
FROM {events}
"""

# Missing labels and scores of both kinds, and one dataset that never states a score.
PRED_MISSING = """
SELECT event_type AS dataset, CAST(user_id % 3 AS STRING) AS prompt,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id*31 + user_id*1777) % 2 AS INT) END AS y_true,
       CASE WHEN event_type = 'view' OR event_id % 11 = 0 THEN NULL
            WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE CAST((event_id*7919 + user_id*104729) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS y_prob
FROM {events}
"""

# Many small runs: five datasets, four models, three prompts.
PRED_RUNS = """
SELECT event_type AS dataset,
       CASE user_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o'
                        WHEN 2 THEN 'Llama-3.3-70B' ELSE 'DeepSeek-V3' END AS model,
       CAST(event_id % 3 AS STRING) AS prompt,
       CAST((event_id*7919 + user_id*104729) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS y_prob,
       CASE WHEN CAST((event_id*31 + user_id*1777) % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE)
              < POW(CAST((event_id*7919 + user_id*104729) % 101 AS DOUBLE) / CAST(100 AS DOUBLE),
                    1 + user_id % 4)
            THEN 1 ELSE 0 END AS y_true
FROM {events}
"""

# Human labels with a length-based score.
PRED_LABELS = """
SELECT d.doc_id, d.lang, l.toxic AS y_true,
       CAST(d.n_chars % 1000 AS DOUBLE) / CAST(999 AS DOUBLE) AS y_prob
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

# Answer texts in the shapes models produce. user_id and a fraction fill them in.
_ANSWERS = """
CASE event_id % 12
  WHEN 0 THEN concat('{{"answer": "', a, '", "confidence": ', c, '}}')
  WHEN 1 THEN concat('Reasoning first. {{"answer": ', a, ', "confidence": 85}} done')
  WHEN 2 THEN concat('{{"answer": 1, "confidence": 0.2}} then {{"answer": ', a, ', "confidence": ', c, '}}')
  WHEN 3 THEN concat('{{''answer'': ''', a, ''', ''confidence'': ', c, ',}}')
  WHEN 4 THEN concat('Answer: ', a, chr(10), 'Confidence: 1.5')
  WHEN 5 THEN concat('{{"answer": "', a, '", "confidence": "high"}}')
  WHEN 6 THEN concat('{{"work": {{"answer": ', a, '}}, "confidence": ', c, '}}')
  WHEN 7 THEN concat('{{"confidence": ', c, '}} {{"answer": "', a, '", "confidence": "n/a"}}')
  WHEN 8 THEN concat('I think it is ', a, ' but cannot say')
  WHEN 9 THEN concat('{{"answer": ', a)
  WHEN 10 THEN concat('{{', chr(10), '  "answer": "  ', a, ' ",', chr(10), '  "confidence": "', c, '"', chr(10), '}}')
  ELSE concat('{{"answer": null}} {{"note": ', a, '}}')
END
"""

TEXT_OUTPUTS = f"""
SELECT event_id AS id, {_ANSWERS.strip()} AS text
FROM (SELECT event_id, CAST(user_id AS STRING) AS a,
             concat('0.', CAST(10 + event_id % 90 AS STRING)) AS c FROM {{events}}) t
"""

# The same after the whole text of a document.
DOCUMENT_OUTPUTS = f"""
SELECT event_id AS id, concat(body, chr(10), {_ANSWERS.strip()}) AS text
FROM (SELECT doc_id AS event_id, text AS body, CAST(n_chars AS STRING) AS a,
             concat('0.', CAST(10 + doc_id % 90 AS STRING)) AS c FROM {{documents}}) t
"""

# Turns of conversations, with an answer taken from the words of each.
TURN_OUTPUTS = """
SELECT conv_id * 100000 + turn AS id, role, body,
       CASE WHEN turn % 4 = 3 THEN body
            ELSE concat(body, ' {{"answer": "', a, CASE WHEN turn % 4 = 2 THEN ' zz' ELSE '' END,
                        '", "confidence": 0.', CAST(10 + conv_id % 90 AS STRING), '}}') END AS text
FROM (SELECT conv_id, turn, role, text AS body, regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1) AS a
      FROM {conversations}) t
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the strings above on the tables of ``sf_dir``."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in sql}
    return spark.sql(sql, **used)


def plain_sql(sql: str) -> str:
    """The same string for an engine where the tables are views."""
    return sql.format(**{name: name for name in TABLES}).strip()
