"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridewave.operators import intake as K
from ridewave.queries.base import query, rnd
from ridewave.queries.scoring import rounded_all

c = F.col
ID_COLS = ("o_orderpriority", "o_orderstatus", "key", "gap")
ID_SQL = """r AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 7=0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 3=0 THEN '.0' ELSE '' END END AS key, CASE WHEN o_orderkey % 5=0 THEN ' ' ELSE 'a_' || o_custkey END AS gap FROM orders),
 s AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS v FROM r UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM r UNION ALL SELECT 'key', key FROM r UNION ALL SELECT 'gap', gap FROM r),
 t AS (SELECT "column", CASE WHEN v IS NOT NULL AND trim(v)<>'' THEN regexp_replace(v, '^(-?\\d+)\\.0+$', '\\1') END AS v FROM s)"""


def id_rows(t):
    n = c("o_orderkey")
    key = F.concat(c("o_custkey").cast("string"), F.when(n % 3 == 0, ".0").otherwise(""))
    return t.orders.select("o_orderpriority", "o_orderstatus", F.when(n % 7 != 0, key).alias("key"),
                           F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("a_"), c("o_custkey").cast("string"))).alias("gap"))


@query("identifier_profile", "A21 F11 F12", f"""WITH {ID_SQL} SELECT "column", count(*) AS rows, count(v) AS present, count(DISTINCT v) AS distinct_values, CAST(min(length(v)) AS INT) AS min_length, CAST(max(length(v)) AS INT) AS max_length,
 count(*) FILTER (regexp_full_match(v,'\\d+')) AS digits, count(*) FILTER (regexp_full_match(v,'[A-Za-z]+')) AS letters, count(*) FILTER (regexp_full_match(v,'[A-Za-z0-9]+') AND NOT regexp_full_match(v,'\\d+') AND NOT regexp_full_match(v,'[A-Za-z]+')) AS alnum,
 count(*) FILTER (regexp_full_match(v,'[A-Za-z0-9_.:/-]+') AND NOT regexp_full_match(v,'[A-Za-z0-9]+')) AS alnum_punct, count(*) FILTER (v IS NOT NULL AND NOT regexp_full_match(v,'[A-Za-z0-9_.:/-]+')) AS other, round(1-count(v)/count(*),6) AS null_rate FROM t GROUP BY ALL""")
def _(t):
    return rounded_all(K.profile_identifiers(id_rows(t), ID_COLS))


@query("document_identifier_profile", "A21", """WITH s AS (SELECT 'lang' AS "column", lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR) FROM documents) SELECT "column", count(*) AS rows, count(CASE WHEN trim(v)<>'' THEN v END) AS present, count(DISTINCT CASE WHEN trim(v)<>'' THEN v END) AS distinct_values FROM s GROUP BY ALL""")
def _(t):
    return K.profile_identifiers(t.documents, ["lang", "source", "doc_id"]).select("column", "rows", "present", "distinct_values")


@query("timestamp_profile", "A22", """WITH s AS (SELECT 'ts' AS "column", strftime(ts,'%Y-%m-%d %H:%M:%S') AS v FROM events UNION ALL SELECT 'odd', CASE WHEN event_id % 9=0 THEN 'n/a' WHEN event_id % 10=0 THEN NULL ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END FROM events), p AS (SELECT "column", v, TRY_CAST(v AS TIMESTAMP) AS t FROM s WHERE v IS NOT NULL AND trim(v)<>'')
SELECT "column", count(*) AS present, count(*) FILTER (t IS NULL) AS unparsed, min(t) AS first, max(t) AS last, count(DISTINCT CAST(t AS DATE)) AS dates FROM p GROUP BY ALL""")
def _(t):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    n = c("event_id")
    rows = t.events.select(text.alias("ts"), F.when(n % 9 == 0, "n/a").when(n % 10 != 0, text).alias("odd"))
    return K.profile_timestamps(rows, ["ts", "odd"])


@query("measure_profile", "A23", """WITH s AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS VARCHAR) AS v, 0 AS a, 100 AS b, true AS w FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), 1, 6, true FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_linenumber=3 THEN 'x' ELSE CAST(l_discount AS VARCHAR) END, 0, 0.09, false FROM lineitem), p AS (SELECT *, TRY_CAST(v AS DOUBLE) AS x FROM s), q AS (SELECT *, x BETWEEN a AND b AND (NOT w OR x=floor(x)) AS ok FROM p)
SELECT "column", count(*) AS present, count(*) FILTER (x IS NULL) AS unparsed, count(*) FILTER (x IS NOT NULL AND NOT ok) AS out_of_contract, min(x) AS minimum, max(x) AS maximum, CASE WHEN bool_and(w) AND count(*) FILTER (x IS NULL)=0 AND count(*) FILTER (NOT ok)=0 THEN sum(x) END AS sum FROM q GROUP BY ALL""")
def _(t):
    rows = t.lineitem.select("l_quantity", "l_linenumber", F.when(c("l_linenumber") == 3, "x").otherwise(c("l_discount").cast("string")).alias("l_discount"))
    return K.profile_measures(rows, {"l_quantity": (0, 100, True), "l_linenumber": (1, 6, True), "l_discount": (0, 0.09, False)})


@query("enumerated_profile", "A24", """WITH k AS (SELECT * FROM (VALUES ('role','user'),('role','assistant'),('role','tool'),('role','other'),('turn','0'),('turn','1'),('turn','other')) t("column", member)), s AS (SELECT 'role' AS "column", role AS v FROM conversations UNION ALL SELECT 'turn', CAST(turn AS VARCHAR) FROM conversations), m AS (SELECT "column", CASE WHEN ("column"='role' AND v IN ('user','assistant','tool')) OR ("column"='turn' AND v IN ('0','1')) THEN v ELSE 'other' END AS member, count(*) AS n FROM s GROUP BY ALL)
SELECT k."column", k.member, coalesce(n,0) AS rows FROM k LEFT JOIN m USING ("column", member)""")
def _(t):
    return K.profile_enums(t.conversations, {"role": ["user", "assistant", "tool"], "turn": ["0", "1"]})


@query("empty_columns", "P20", """SELECT 'gap' AS "column" WHERE (SELECT count(*) FROM orders)>0""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.when(c("o_orderkey") % 2 == 0, " ").alias("gap"))
    return K.empty_columns(rows)


class Longest:
    name, how = "longest", "max"

    def observe(self, values):
        return values.str.len().max()


class Letters:
    name, how = "letters", "sum"

    def observe(self, values):
        return values.str.count("[A-Za-z]").sum()


@query("custom_accumulators", "E2", """SELECT 'longest' AS measure, max(length(p_name))::DOUBLE AS value FROM part UNION ALL SELECT 'letters', sum(length(regexp_replace(p_name,'[^A-Za-z]','','g')))::DOUBLE FROM part""")
def _(t):
    return K.profile_with(t.part, "p_name", [Longest(), Letters()])
