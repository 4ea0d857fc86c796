import pytest

import __spark_entry__
from quizloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(name, spark, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), registry.SQL[name])


def test_every_query_has_sql():
    # Byte pair encoding can't be written in SQL; test_training_data_with_a_tokenizer_file holds it.
    assert set(registry.QUERIES) == set(registry.SQL) | {"training_data_bpe"}


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r["answer"] for r in rows} <= set("12345")
