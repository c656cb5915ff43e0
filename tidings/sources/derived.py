"""Labelled short messages derived from the conversation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.functions.scores import encode_label

# The same text runs in Spark and DuckDB.  Every conversation turn becomes one
# message with its whole text; about one label in 29 is flipped, so that models
# have something to get wrong.
SMS_SQL = """
SELECT conv_id * 1000 + turn AS msg_id,
       CASE WHEN ((conv_id * 31 + turn * 5) % 7 = 0)
              <> ((conv_id * 13 + turn * 17) % 29 = 0) THEN 'spam' ELSE 'ham' END AS label,
       CASE WHEN (conv_id * 31 + turn * 5) % 7 <> 0 THEN
              CASE WHEN conv_id % 5 = 0 THEN concat(text, ' Call me at 5, thanks!') ELSE text END
            WHEN conv_id % 4 = 0 THEN
              concat('WINNER!! You won a £', CAST(100 + conv_id % 900 AS STRING),
                     ' prize &amp; bonus. Call 090',
                     CAST(10000000 + (conv_id * 7919) % 90000000 AS STRING), ' now! ', text)
            WHEN conv_id % 4 = 1 THEN
              concat('URGENT: claim your FREE gift at http://win', CAST(conv_id AS STRING),
                     '.example.com/x?id=', CAST(turn AS STRING), ' or text STOP to ',
                     CAST(80000 + conv_id % 9999 AS STRING), '. ', text)
            WHEN conv_id % 4 = 2 THEN
              concat('You have won a ', CAST(1000 + conv_id AS STRING),
                     ' pound prize?? Reply now, offer expires 12h! ', text)
            ELSE concat('Cash bonus 50p per text. Contact www.promo', CAST(conv_id AS STRING),
                        '.net today!!! ', text) END AS text
FROM {conversations}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as its files lie; their splits decide on the tasks."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, label (ham or spam), text."""
    return spark.sql(
        SMS_SQL.replace("{conversations}", "{turns}"),
        turns=table(spark, sf_dir, "conversations"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the label as a number."""
    messages = sms(spark, sf_dir)
    return messages.withColumn("label", encode_label(messages["label"]))
