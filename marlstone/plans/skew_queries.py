"""Queries of problem 2."""

from marlstone.operators import skew
from marlstone.runtime import read_table


def p2_found(spark, d):
    return skew.heavy_keys(read_table(spark, d, "field_index")).select("namespace", "field_name", "field_value")


def p2_key_counts(spark, d):
    return skew.segment_key_counts(read_table(spark, d, "field_index"))


def p2_agency_rows(spark, d):
    return skew.rows_and_distinct(read_table(spark, d, "jobs"), "agency", "jobId")


QUERIES = {"p2_found": p2_found, "p2_key_counts": p2_key_counts, "p2_agency_rows": p2_agency_rows}

_IDS = "ids AS (SELECT DISTINCT namespace, field_name, field_value, container * 65536 + b AS id FROM (SELECT namespace, field_name, field_value, container, unnest(bitmaps) AS b FROM field_index) WHERE b IS NOT NULL AND container IS NOT NULL)"

SQL = {
    "p2_found": f"""WITH {_IDS}, n AS (SELECT namespace, field_name, field_value, count(*) AS n FROM ids GROUP BY ALL),
        t AS (SELECT namespace, field_name, count(DISTINCT id) AS total FROM ids GROUP BY ALL)
        SELECT n.namespace, n.field_name, n.field_value FROM n JOIN t ON n.namespace IS NOT DISTINCT FROM t.namespace
        AND n.field_name IS NOT DISTINCT FROM t.field_name WHERE n.n * 100 >= t.total * 3""",
    "p2_key_counts": f"WITH {_IDS} SELECT namespace, field_name, field_value, count(*) AS n_ids FROM ids GROUP BY ALL",
    "p2_agency_rows": "SELECT agency, count(*) AS n_rows, count(DISTINCT jobId) AS n_ids FROM jobs GROUP BY agency",
}
