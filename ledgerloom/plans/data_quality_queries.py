"""Queries p2 to p4: orphan references, drifting schemas, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import multivalue, references, schema_drift
from ledgerloom.runtime import durable, table


def _ref_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("clients", "agents", "policies", "statement_lines", "removed_keys")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.find_orphans(_ref_tables(spark, d))


def p2_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_ref_tables(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "mapping_review")).select("file_id", "change_kind", "old_header", "new_header")


def p3_consistent_table(spark: SparkSession, d: str) -> DataFrame:
    review = table(spark, d, "mapping_review")
    return schema_drift.consistent_table(review, table(spark, d, "raw_rows"), durable(schema_drift.changes(review)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.explode_values(table(spark, d, "agents"), "rec_id", "license_states")


QUERIES = {
    "p2_found": p2_found,
    "p2_orphan_counts": p2_orphan_counts,
    "p3_found": p3_found,
    "p3_consistent_table": p3_consistent_table,
    "p4_found": p4_found,
}

_KEY = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


def _orphans_sql(child: str, rec: str, field: str, parent: str, pkey: str, scope: bool) -> str:
    s = "carrier" if scope else "''"
    return f"""
    SELECT '{child}' AS table_name, c.rec_id, '{field}' AS field_name,
      CASE WHEN r.at IS NOT NULL AND (p.at IS NULL OR r.at <= c.loaded_at) THEN 'deleted'
           WHEN p.at IS NULL THEN 'missing' WHEN p.at > c.loaded_at THEN 'late' END AS orphan_kind,
      strftime(c.loaded_at, '%Y-%m') AS load_month
    FROM (SELECT {rec} AS rec_id, {s} AS sc, {_KEY.format(c=field)} AS k, loaded_at FROM {child} WHERE {field} IS NOT NULL) c
    LEFT JOIN (SELECT {s} AS sc, {_KEY.format(c=pkey)} AS k, min(loaded_at) AS at FROM {parent} WHERE {pkey} IS NOT NULL GROUP BY 1, 2) p
      ON p.sc = c.sc AND p.k = c.k
    LEFT JOIN (SELECT {s} AS sc, {_KEY.format(c='key_value')} AS k, min(removed_at) AS at FROM removed_keys
               WHERE table_name = '{parent}' AND field_name = '{pkey}' GROUP BY 1, 2) r ON r.sc = c.sc AND r.k = c.k"""


_ORPHANS = (
    "SELECT * FROM ("
    + " UNION ALL ".join(
        (
            _orphans_sql("policies", "rec_id", "client_id", "clients", "client_id", False),
            _orphans_sql("policies", "rec_id", "writing_agent_npn", "agents", "npn", False),
            _orphans_sql("statement_lines", "line_id", "carrier_member_id", "policies", "carrier_member_id", True),
        )
    )
    + ") WHERE orphan_kind IS NOT NULL"
)

SQL = {
    "p2_found": _ORPHANS,
    "p2_orphan_counts": f"SELECT table_name, field_name, orphan_kind, load_month, count(*) AS orphan_rows FROM ({_ORPHANS}) GROUP BY ALL",
    "p4_found": r"""
    WITH tokens AS (
      SELECT rec_id, regexp_extract_all(license_states, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^"'',;|/&\n\r\t]+|[,;|/&\n\r\t]') AS t
      FROM agents WHERE license_states IS NOT NULL),
    folded AS (
      SELECT rec_id, string_split(array_to_string(list_transform(t, lambda x: CASE
          WHEN regexp_full_match(x, '[,;|/&\n\r\t]') THEN chr(1)
          WHEN x[1] = '"' THEN chr(2) || replace(x[2:-2], '""', '"')
          WHEN x[1] = '''' THEN chr(2) || replace(x[2:-2], '''''', '''')
          ELSE regexp_replace(x, '(?i)\band\b', chr(1), 'g') END), ''), chr(1)) AS parts
      FROM tokens),
    vals AS (
      SELECT rec_id, list_filter(list_transform(flatten(list_transform(parts, lambda v: CASE
          WHEN contains(v, chr(2)) THEN [replace(v, chr(2), '')]
          WHEN regexp_full_match(trim(v), '[A-Za-z]{2}(\s+[A-Za-z]{2})+') THEN regexp_split_to_array(trim(v), '\s+')
          ELSE [v] END)), lambda v: trim(v)), lambda v: v <> '') AS vs
      FROM folded)
    SELECT rec_id, CAST(unnest(range(1, len(vs) + 1)) AS BIGINT) AS pos_no, unnest(vs) AS license_value FROM vals""",
}
