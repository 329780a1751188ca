"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from cohortloom.plans import roles


def _text(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _counts(column: str, values, alias: str = "{}") -> str:
    """One conditional count per value."""
    return ", ".join(
        f"""CAST(count(*) FILTER (WHERE {column} = '{v}') AS BIGINT) AS "{alias.format(v)}\"""" for v in values
    )


LABS = f"""(SELECT event_id, user_id, event_type, value,
    CASE WHEN value >= {roles.ABNORMAL_FROM} THEN 'abnormal' WHEN value < {roles.DELTA_BELOW} THEN 'delta' END AS flag
    FROM events) labs"""
MARKERS = _text(roles.MARKERS)
TITLED = "(contains(p_name, 'ring') OR contains(p_name, 'red'))"
OUTCOME = f"""CASE WHEN (o_totalprice >= {roles.COSTLY}) <> (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10 = 0)
    THEN 'Y' ELSE 'N' END"""
TARGET = "CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'N' ELSE 'Y' END"
COHORT = """(SELECT o_custkey, count(*) AS cohort_rows FROM orders
    JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus = 'F' AND c_mktsegment = 'AUTOMOBILE' GROUP BY o_custkey) cohort"""
MATRIX = f"""(SELECT user_id, {_counts("event_type", roles.MARKERS)} FROM events
    WHERE event_type IN ({MARKERS}) GROUP BY user_id) matrix"""
MARKER_COLUMNS = ", ".join(f'"{c}"' for c in roles.MARKERS)


def _code_text(where: str) -> str:
    # parts hold a million codes each
    return f"""SELECT user_id AS "SUBJECT_ID", part, string_agg(event_type, ' ' ORDER BY event_type) AS codes
        FROM (SELECT user_id, event_type,
                (row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1) // 1000000 AS part
              FROM events {where}) numbered
        GROUP BY user_id, part"""


def _xxhash64(key: str, table: str) -> str:
    """XXH64 of an 8-byte integer with seed 42 (42 + length 8 = 50), spelled out in 128-bit arithmetic."""
    m = "18446744073709551616::UHUGEINT"
    p1, p2, p3 = "11400714785074694791", "14029467366897019727", "1609587929392839161"
    p4, p5 = "9650029242287828579", "2870177450012600261"

    def times(x: str, p: str) -> str:
        return f"(({x}) * {p}::UHUGEINT) % {m}"

    def rotate(x: str, bits: int) -> str:
        return f"((({x}) * {1 << bits}::UHUGEINT) % {m} + ({x}) // {1 << (64 - bits)}::UHUGEINT)"

    def shift(x: str, bits: int) -> str:
        return f"xor({x}, {x} // {1 << bits}::UHUGEINT)"

    return f"""SELECT key, ((h - CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END) % 10 + 10) % 10 AS tenth
        FROM (SELECT key, CAST({shift("h", 32)} AS HUGEINT) AS h
        FROM (SELECT key, {times(shift("h", 29), p3)} AS h
        FROM (SELECT key, {times(shift("h", 33), p2)} AS h
        FROM (SELECT key, ({times(rotate("h", 27), p1)} + {p4}::UHUGEINT) % {m} AS h
        FROM (SELECT key, xor((50::UHUGEINT + {p5}::UHUGEINT) % {m}, {times(rotate("k", 31), p1)}) AS h
        FROM (SELECT key, {times("key::UHUGEINT", p2)} AS k FROM (SELECT {key} AS key FROM {table}) t0) t1) t2) t3) t4) t5) t6"""


ORACLE: dict[str, str] = {
    "project_rename": """SELECT o_custkey AS "SUBJECT_ID", o_orderkey AS "HADM_ID", o_orderdate AS "ADMITTIME" FROM orders""",
    "csv_round_trip": "SELECT * FROM orders",
    "parquet_round_trip": "SELECT * FROM orders",
    "drop_header_rows": """SELECT o_orderkey AS "HADM_ID", o_custkey AS "SUBJECT_ID", o_orderpriority AS "ADMISSION_TYPE"
        FROM orders""",
    "code_table": f"""SELECT "ITEMCODE", "NAME", count(event_id) AS n
        FROM (VALUES {", ".join(f"('{c}', '{n}')" for c, n in roles.MARKERS.items())}) AS codes("ITEMCODE", "NAME")
        LEFT JOIN events ON event_type = "ITEMCODE" GROUP BY "ITEMCODE", "NAME\"""",
    "drop_columns": "SELECT event_id, ts, user_id, event_type FROM events",
    "project_except": "SELECT p_partkey, p_type, p_size FROM part",
    "length_of_stay": """SELECT o_custkey AS "SUBJECT_ID", l_orderkey AS "HADM_ID", l_linenumber,
        CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS los_days
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "age_years": """SELECT o_custkey AS "SUBJECT_ID", l_orderkey AS "HADM_ID", l_linenumber,
        round(date_diff('day', o_orderdate, l_shipdate) / 365.0::DOUBLE, 1) + 0.0::DOUBLE AS "AGE"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "feature_matrix_select": f"""SELECT user_id AS "SUBJECT_ID", {MARKER_COLUMNS} FROM {MATRIX}""",
    "filter_equals": """SELECT o_orderkey AS "HADM_ID", o_orderstatus AS "DIAGNOSIS" FROM orders WHERE o_orderstatus = 'F'""",
    "flag_equals_one": """SELECT l_orderkey, l_partkey, CAST(l_linenumber AS VARCHAR) AS "WARNING" FROM lineitem
        WHERE l_linenumber = 1""",
    "filter_abnormal_contains": f"""SELECT event_id AS "ROW_ID", user_id AS "SUBJECT_ID", event_type AS "ITEMID",
        value AS "VALUENUM" FROM {LABS} WHERE contains(flag, 'abnormal')""",
    "filter_flag_not_null": f"""SELECT event_id AS "ROW_ID", user_id AS "SUBJECT_ID", event_type AS "ITEMID",
        value AS "VALUENUM", flag AS "FLAG" FROM {LABS} WHERE flag IS NOT NULL""",
    "title_search": f"""SELECT p_partkey AS "ICD9_CODE", p_name AS "SHORT_TITLE" FROM part WHERE {TITLED}""",
    "title_regex_flag": """SELECT p_partkey AS "ICD9_CODE", regexp_matches(p_name, 'ring') AS found FROM part""",
    "mortality_target": f"""SELECT o_orderkey AS "HADM_ID", {TARGET} AS "TARGET" FROM orders""",
    "label_from_target": f"""SELECT o_orderkey AS "HADM_ID",
        CASE WHEN {TARGET} = 'Y' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "LABEL" FROM orders""",
    "codes_in_set": f"""SELECT event_id AS "ROW_ID", user_id AS "SUBJECT_ID", event_type AS "ITEMID" FROM events
        WHERE event_type IN ({MARKERS})""",
    "codes_not_in_set": f"""SELECT event_id AS "ROW_ID", user_id AS "SUBJECT_ID", event_type AS "ITEMID" FROM events
        WHERE event_type IS NULL OR event_type NOT IN ({MARKERS})""",
    "patient_admissions": """SELECT c_custkey AS "SUBJECT_ID", c_mktsegment AS "GENDER", o_orderkey AS "HADM_ID",
        o_orderpriority AS "ADMISSION_TYPE", o_orderstatus AS "DIAGNOSIS"
        FROM customer JOIN orders ON c_custkey = o_custkey""",
    "deaths_only": """SELECT c_custkey AS "SUBJECT_ID", c_mktsegment AS "GENDER", o_orderkey AS "HADM_ID",
        o_orderstatus AS "DEATHTIME" FROM customer JOIN orders ON c_custkey = o_custkey
        WHERE nullif(o_orderstatus, 'P') IS NOT NULL""",
    "admission_code_matrix": f"""SELECT o_custkey AS "SUBJECT_ID", o_orderkey AS "HADM_ID",
        o_orderpriority AS "ADMISSION_TYPE", o_orderstatus AS "DIAGNOSIS", {MARKER_COLUMNS}
        FROM orders JOIN {MATRIX} ON user_id = o_custkey""",
    "cohort_micro_events": f"""SELECT o.o_custkey AS "SUBJECT_ID", l_returnflag AS "SPEC_TYPE_DESC",
        l_linestatus AS "ORG_NAME", count(*) AS n_events, CAST(sum(cohort_rows) AS BIGINT) AS n_rows
        FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN {COHORT} ON cohort.o_custkey = o.o_custkey
        GROUP BY o.o_custkey, l_returnflag, l_linestatus""",
    "cohort_diagnoses": f"""SELECT o.o_custkey AS "SUBJECT_ID", l_partkey AS "ICD9_CODE", count(*) AS n_events,
        CAST(sum(cohort_rows) AS BIGINT) AS n_rows
        FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN {COHORT} ON cohort.o_custkey = o.o_custkey
        GROUP BY o.o_custkey, l_partkey""",
    "cohort_subjects": f"""SELECT o_custkey AS "SUBJECT_ID", o_orderkey AS "HADM_ID" FROM orders
        WHERE o_custkey IN (SELECT o_custkey FROM {COHORT})""",
    "csv_text_round_trip": "SELECT doc_id, text FROM documents",
    "codes_in_table": f"""SELECT l_partkey AS "ICD9_CODE", count(*) AS n FROM lineitem
        WHERE l_partkey IN (SELECT p_partkey FROM part WHERE {TITLED}) GROUP BY l_partkey""",
    "codes_not_in_table": f"""SELECT l_partkey AS "ICD9_CODE", count(*) AS n FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE {TITLED}) GROUP BY l_partkey""",
    "contingency_counts": """SELECT CAST(l_orderkey AS VARCHAR) AS "HADM_ID", CAST(l_partkey AS VARCHAR) AS "ICD9_CODE",
        count(*) AS n FROM lineitem GROUP BY ALL""",
    "matrix_descending": f"""SELECT user_id AS "SUBJECT_ID", {MARKER_COLUMNS} FROM {MATRIX} ORDER BY user_id DESC""",
    "score_auc": f"""SELECT round((sum(r) FILTER (WHERE y) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * (n - n1)), 9) AS area_under_roc
        FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r,
                count(*) FILTER (WHERE y) OVER () AS n1, count(*) OVER () AS n
              FROM (SELECT o_totalprice AS s, {OUTCOME} = 'Y' AS y FROM orders) scored) ranked GROUP BY n1, n""",
    "kmeans_conditions": """SELECT DISTINCT user_id AS "SUBJECT_ID", true AS nearest, true AS central FROM events""",
    "diagnoses_by_title": f"""SELECT o_custkey AS "SUBJECT_ID", p_partkey AS "ICD9_CODE", p_name AS "SHORT_TITLE"
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE {TITLED}""",
    "code_overlap_count": f"SELECT count(*) AS n FROM part WHERE p_type IN ({_text(roles.CHAPTERS[:2])}, {MARKERS})",
    "top_diagnoses_titled": """SELECT p_partkey AS "ICD9_CODE", p_name AS "SHORT_TITLE", n FROM part
        JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey
              ORDER BY n DESC, l_partkey LIMIT 20) top ON l_partkey = p_partkey""",
    "one_hot_chain": f"""SELECT o_custkey AS "SUBJECT_ID", o_orderkey AS "HADM_ID", types.*, diagnoses.*
        FROM orders
        JOIN (SELECT o_custkey AS s1, {_counts("o_orderpriority", roles.PRIORITIES, "ADMISSION_TYPE_{}")}
              FROM orders GROUP BY o_custkey) types ON s1 = o_custkey
        JOIN (SELECT o_custkey AS s2, {_counts("o_orderstatus", roles.STATUSES, "DIAGNOSIS_{}")}
              FROM orders GROUP BY o_custkey) diagnoses ON s2 = o_custkey""".replace(
        "types.*", ", ".join(f'"ADMISSION_TYPE_{p}"' for p in roles.PRIORITIES)
    ).replace("diagnoses.*", ", ".join(f'"DIAGNOSIS_{s}"' for s in roles.STATUSES)),
    "whitelist_semi_join": """SELECT o_custkey AS "SUBJECT_ID", o_orderkey AS "HADM_ID",
        o_orderpriority AS "ADMISSION_TYPE" FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "count_by_key": """SELECT user_id AS "SUBJECT_ID", count(*) AS n FROM events GROUP BY user_id""",
    "count_by_two_keys": """SELECT user_id AS "SUBJECT_ID", event_type AS "ITEMID", count(*) AS n FROM events
        GROUP BY user_id, event_type""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events", "part")
    ),
    "matrix_means": f"""SELECT {", ".join(f'avg("{c}") AS "{c}"' for c in roles.MARKERS)} FROM {MATRIX}""",
    "cube_counts": """SELECT o_orderstatus AS "DIAGNOSIS", o_orderpriority AS "ADMISSION_TYPE", count(*) AS n FROM orders
        GROUP BY CUBE (o_orderstatus, o_orderpriority) HAVING o_orderstatus IS NOT NULL
        ORDER BY "DIAGNOSIS", "ADMISSION_TYPE" NULLS FIRST""",
    "cube_all_counts": """SELECT o_orderstatus AS "DIAGNOSIS", o_orderpriority AS "ADMISSION_TYPE", count(*) AS n
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "rollup_counts": """SELECT o_orderstatus AS "DIAGNOSIS", o_orderpriority AS "ADMISSION_TYPE", count(*) AS n,
        CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders
        GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING grouping(o_orderstatus, o_orderpriority) < 3""",
    "crosstab_counts": f"""SELECT CAST(user_id AS VARCHAR) AS "SUBJECT_ID_ITEMID",
        {_counts("event_type", roles.EVENT_TYPES)} FROM events GROUP BY user_id""",
    "one_hot_counts": f"""SELECT o_custkey AS "SUBJECT_ID", {_counts("o_orderpriority", roles.PRIORITIES)}
        FROM orders GROUP BY o_custkey""",
    "codes_per_subject": _code_text(""),
    "listed_codes_per_subject": _code_text(f"WHERE event_type IN ({MARKERS})"),
    "describe_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
        round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM orders"""
        for c in ("o_custkey", "o_totalprice")
    ),
    "top_k_counts": """SELECT user_id AS "SUBJECT_ID", count(*) AS n FROM events GROUP BY user_id
        ORDER BY n DESC, user_id LIMIT 10""",
    "union_codes": """SELECT "SUBJECT_ID", "XCODE", count(*) AS n FROM (
        SELECT o_custkey AS "SUBJECT_ID", 'type:' || o_orderpriority AS "XCODE" FROM orders
        UNION ALL SELECT o_custkey, 'diagnosis:' || o_orderstatus FROM orders) codes GROUP BY "SUBJECT_ID", "XCODE\"""",
    "training_rows": f"""WITH codes AS (
            SELECT user_id AS s, 'lab:' || event_type AS x FROM {LABS}
            WHERE flag IS NOT NULL AND event_type IN ({MARKERS})
            UNION ALL
            SELECT o_custkey, 'icd:' || p_type FROM lineitem JOIN part ON p_partkey = l_partkey
            JOIN orders ON o_orderkey = l_orderkey WHERE {TITLED}),
        matrix AS (SELECT s, {_counts("x", [f"lab:{c}" for c in roles.MARKERS] + [f"icd:{c}" for c in roles.CHAPTERS])}
            FROM codes GROUP BY s),
        visits AS (SELECT o_custkey AS "SUBJECT_ID", o_orderkey AS "HADM_ID", c_mktsegment AS "GENDER",
            o_orderpriority AS "ADMISSION_TYPE", o_orderstatus AS "DIAGNOSIS", o_totalprice AS "COST", {OUTCOME} AS "TARGET"
            FROM orders JOIN customer ON c_custkey = o_custkey),
        genders AS (SELECT "SUBJECT_ID" AS s, {_counts('"GENDER"', roles.SEGMENTS, "GENDER_{}")} FROM visits GROUP BY ALL),
        types AS (SELECT "SUBJECT_ID" AS s, {_counts('"ADMISSION_TYPE"', roles.PRIORITIES, "ADMISSION_TYPE_{}")}
            FROM visits GROUP BY ALL)
        SELECT visits.*, CASE WHEN "TARGET" = 'Y' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "LABEL",
            matrix.* EXCLUDE (s), genders.* EXCLUDE (s), types.* EXCLUDE (s)
        FROM visits JOIN matrix ON matrix.s = "SUBJECT_ID" JOIN genders ON genders.s = "SUBJECT_ID"
        JOIN types ON types.s = "SUBJECT_ID\"""",
    "feature_vectors": f"""SELECT user_id AS "SUBJECT_ID",
        {", ".join(f'CAST("{c}" AS DOUBLE) AS "f_{c}"' for c in roles.MARKERS)} FROM {MATRIX}""",
    "scaled_features": f"""SELECT user_id AS "SUBJECT_ID",
        {", ".join(f'round("{c}" / stddev_samp("{c}") OVER (), 6) AS "s_{c}"' for c in roles.EVENT_TYPES)}
        FROM (SELECT user_id, {_counts("event_type", roles.EVENT_TYPES)} FROM events GROUP BY user_id) matrix""",
    "train_test_split": f"""SELECT CASE WHEN tenth < 7 THEN 'train' ELSE 'test' END AS part, count(*) AS n,
        CAST(sum(key) AS BIGINT) AS key_sum FROM ({_xxhash64("o_custkey", "orders")}) hashed GROUP BY ALL""",
}

_CELLS = sorted(
    [(f"lab:{c}", f"lab:{c}") for c in roles.MARKERS if c != "refund"]
    + [(f"icd:{c}", f"icd:{c}") for c in roles.CHAPTERS]
    + [(f"GENDER:{v}", f"GENDER_{v}") for v in roles.SEGMENTS]
    + [(f"ADMISSION_TYPE:{v}", f"ADMISSION_TYPE_{v}") for v in roles.PRIORITIES]
)
ORACLE["training_vectors"] = f"""SELECT "HADM_ID", "LABEL",
    {", ".join(f'CAST("{dense}" AS DOUBLE) AS "{cell}"' for cell, dense in _CELLS)}, "COST"
    FROM ({ORACLE["training_rows"]}) dense"""
ORACLE["logistic_conditions"] = f"""SELECT "HADM_ID", true AS by_coefficients, true AS likelier_class, true AS at_optimum
    FROM ({ORACLE["training_rows"]}) dense"""
