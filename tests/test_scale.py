"""How work and disk grow: what must not be computed again for every line, and what must not be shuffled or kept."""

import re
import time

import pytest
from pyspark.sql import functions as F

from marlspike.functions import text as T
from marlspike.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_excerpts_look_at_a_text_once(spark):
    """A text of many lines is cut once for all of them: cutting it again for each line takes minutes."""
    body = "\n".join("" if k % 9 == 4 else f"line {k}" for k in range(30_000))
    df = spark.createDataFrame([(body, 15_000, 15_003), ("a\n\nb\nc\n\nd", 3, 3), ("", 1, 1)], "content string, s int, e int")
    began = time.time()
    got = [r.x for r in df.select(T.excerpt(F.col("content"), F.col("s"), F.col("e")).alias("x")).collect()]
    assert time.time() - began < 20
    assert tuple(got[0]) == ("\n".join(f"line {k}" for k in range(14999, 15007)), 15000, 15007)
    assert tuple(got[1]) == ("b\nc", 3, 4) and got[2] is None


@pytest.mark.parametrize("name", ["fts_bm25_topk", "fts_phrase_topk", "ngram_search"])
def test_pairs_of_query_and_item_stay_in_their_task(spark, name):
    """No exchange by query and item: all pairs would go through it, which are many times the text."""
    df = QUERIES[name](spark, SF)
    df.collect()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    assert exchanges and not [e for e in exchanges if "query_id" in e and re.search(r"\bid#", e)]
