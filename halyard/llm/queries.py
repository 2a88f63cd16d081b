"""Every query of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import chat, decontaminate, exact_dedup, licenses, line_dedup, packing, sharding, simhash, suffix_dedup, toxicity
from halyard.llm.common import prepare

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (exact_dedup, decontaminate, line_dedup, packing, chat, suffix_dedup, simhash, toxicity, licenses, sharding)


def modest(query: Query) -> Query:
    """The query, its rows going to Python in small batches."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {k: modest(v) for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
