"""Schema types by walking the JSON-LD tree level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.html import ld_json_blocks
from ..functions.text import strict_json
from ..session import materialize

# the JSON parser takes a thousand levels; the walk needs one more to end
MOST_LEVELS = 1002
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

# a level holds the children that are nodes themselves, and the types
WALK = """
WITH RECURSIVE nodes (page_id, key, node) MAX RECURSION LEVEL {levels} AS (
  SELECT page_id, CAST(NULL AS STRING), node FROM {blocks}
  UNION ALL
  SELECT up.page_id, below.key, below.value
  FROM nodes AS up, LATERAL variant_explode(up.node) AS below
  WHERE below.key = '@type' OR schema_of_variant(below.value) RLIKE '^(ARRAY|OBJECT)'
), named AS (
  SELECT page_id, explode_outer(CASE
    WHEN key IS NULL OR key <> '@type' THEN NULL
    WHEN schema_of_variant(node) LIKE 'ARRAY%' THEN try_variant_get(node, '$', 'array<string>')
    WHEN schema_of_variant(node) = 'STRING' AND try_variant_get(node, '$', 'string') <> ''
      THEN array(try_variant_get(node, '$', 'string'))
  END) AS type
  FROM nodes
)
SELECT page_id, array_sort(collect_set(type)) AS schema_types FROM named GROUP BY page_id
"""


def schema_types_walk(pages: DataFrame) -> DataFrame:
    """(page_id, schema_types): every ``@type`` at any depth of the valid blocks, sorted.

    The cross-check of ``schema_types_tree``, which finds the same names by pattern inside the
    row. An invalid block counts for nothing; a page without types has the empty array. Page
    ids must be unique. The result is stored, as the walk needs a session setting lifted: the
    rows of a recursive query are limited by default, and here they grow with the pages.
    """
    spark = pages.sparkSession
    blocks = pages.select("page_id", F.explode_outer(ld_json_blocks(F.col("html"))).alias("b"))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        walked = spark.sql(
            WALK, blocks=blocks.select("page_id", strict_json(F.col("b")).alias("node")),
            levels=MOST_LEVELS,
        )
        return materialize(walked, "schema-types")
    finally:
        spark.conf.set(ROW_LIMIT, before)
