"""What reaches the scan, what shuffles, what stays out of Python."""

import re

import pytest
from pyspark.sql import functions as F

from tidings.operators import splits, vocabulary
from tidings.plans.queries import QUERIES
from tidings.sources import messages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["clean_v1_documents", "pre_v2_pages", "indicator_chips", "compare_rules", "tokens_v2", "split_assign"]
)
def test_row_wise_queries_shuffle_only_to_use_all_cores(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    exchanges = re.findall(r"Exchange (\w+)", text)
    assert set(exchanges) <= {"RoundRobinPartitioning"}
    assert "Python" not in text


def test_scans_read_needed_columns_only(spark, sf):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(QUERIES["pre_v2_documents"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint>" in plan(QUERIES["split_exact_documents"](spark, sf))
    assert "ReadSchema: struct<quality:int>" in plan(QUERIES["class_distribution_documents"](spark, sf))


def test_replies_are_unpacked_without_scoring_twice(spark, sf):
    text = plan(QUERIES["eval_metrics"](spark, sf))
    assert "size(array(" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_split_folders_are_pruned(spark, tmp_path):
    df = splits.assign_split(spark.range(200).select(
        F.col("id").alias("msg_id"), F.col("id").cast("string").alias("text"), F.lit(0).alias("label")
    ))
    messages.write_splits(df, str(tmp_path / "s"), "parquet")
    text = plan(messages.read_split(spark, str(tmp_path / "s"), "test", "parquet"))
    assert re.search(r"PartitionFilters: \[[^]]*split[^]]*= test", text)
    assert "isnotnull(label" in text


def test_vocabulary_takes_one_combining_shuffle(spark):
    df = spark.createDataFrame([(0, ["a", "b"])], "msg_id LONG, tokens ARRAY<STRING>")
    text = plan(vocabulary.term_counts(df))
    assert text.count("Exchange hashpartitioning(term") == 1
    assert text.count("HashAggregate") == 2
    assert "SortAggregate" not in plan(
        vocabulary.fit_word_index(df.withColumnRenamed("tokens", "words"))
    )


def test_no_cross_products(spark, sf):
    for name in ("class_weights", "split_exact", "vocab_tfidf_v2", "chart_matrix", "compare_best"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
