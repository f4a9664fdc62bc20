"""Input views of the registered queries, in SQL both engines read the same way.

The test tables hold no missing values, so the states are written in by key arithmetic
over all rows.  ``{name}`` is a table or another view.
"""

VIEWS: dict[str, str] = {}

# one row per entity, with decision date, calendar week, month code and label
VIEWS["spine"] = """
SELECT case_id, base_order, decision_date,
       CASE WHEN case_id % 211 = 7 THEN NULL WHEN wk % 17 = 4 THEN wk + 1 ELSE wk END AS week_num,
       CASE WHEN case_id % 223 = 7 THEN NULL
            ELSE CAST(year(any_date) * 100 + month(any_date) AS BIGINT) END AS month_code,
       CASE WHEN case_id % 53 = 1 THEN NULL WHEN case_id % 59 = 1 THEN 2
            WHEN CAST(floor(balance) AS BIGINT) % 10 < 2 THEN 1 ELSE 0 END AS target,
       balance, segment
FROM (SELECT c_custkey AS case_id, c_custkey AS base_order,
             DATE '1998-01-01' + CAST(c_custkey % 1000 AS INT) AS any_date,
             CASE WHEN c_custkey % 29 = 0 THEN NULL
                  ELSE DATE '1998-01-01' + CAST(c_custkey % 1000 AS INT) END AS decision_date,
             CAST(floor((c_custkey % 1000) / 7e0) AS BIGINT) AS wk,
             c_acctbal AS balance, c_mktsegment AS segment
      FROM {customer}) c
"""

# one-to-many source: key defects, six numeric states, four date states, three text states
VIEWS["child"] = """
SELECT o_orderkey AS row_id,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN -1 - o_custkey
            WHEN o_custkey % 13 = 5 THEN o_custkey + 1 ELSE o_custkey END AS case_id,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN -1
            ELSE o_orderkey % 50 END AS num_group1,
       concat('shard_', CAST(o_orderkey % 3 AS STRING)) AS shard,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'bad'
            WHEN o_custkey % 31 = 3 THEN '0' WHEN o_orderkey % 13 = 0 THEN '0'
            WHEN o_orderkey % 17 = 0 THEN 'inf' WHEN o_orderkey % 43 = 0 THEN 'NaN'
            WHEN o_orderkey % 19 = 0 THEN concat('-', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING))
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS amount_text,
       CASE WHEN o_custkey % 17 = 2 THEN NULL WHEN o_orderkey % 5 = 0 THEN NULL
            WHEN o_orderkey % 9 = 0 THEN 0e0 WHEN o_orderkey % 23 = 0 THEN -1e0 * floor(o_totalprice)
            ELSE floor(o_totalprice) END AS amount,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 4 AS DOUBLE)
            WHEN o_orderkey % 41 = 0 THEN 25e-1 ELSE CAST(o_orderkey % 4 AS DOUBLE) END AS pay_count,
       CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 21 = 0 THEN ' '
            WHEN o_orderkey % 27 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
       CASE WHEN o_orderkey % 12 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS event_day,
       CASE WHEN o_orderkey % 8 = 1 THEN NULL WHEN o_orderkey % 15 = 2 THEN '' ELSE o_orderpriority END AS code,
       CASE WHEN o_orderkey % 14 = 1 THEN NULL ELSE o_orderstatus END AS side
FROM {orders}
"""

# second one-to-many source
VIEWS["detail"] = """
SELECT l_partkey AS case_id, CAST(l_linenumber AS BIGINT) AS num_group1, l_orderkey AS row_id,
       CASE WHEN l_partkey % 19 = 4 THEN NULL WHEN l_orderkey % 6 = 0 THEN NULL WHEN l_linenumber = 7 THEN 0e0
            WHEN l_orderkey % 37 = 0 THEN -1e0 * l_quantity ELSE l_quantity END AS amount,
       CASE WHEN l_orderkey % 11 = 4 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS event_day,
       CAST(l_shipdate AS DATE) AS open_day,
       CASE WHEN l_returnflag = 'A' THEN NULL
            ELSE CAST(l_shipdate AS DATE) + CAST(l_linenumber * 100 AS INT) END AS close_day,
       l_returnflag AS flag, l_linestatus AS status
FROM {lineitem}
"""

# at most one row per entity: summary fields next to the detail rows
VIEWS["summary"] = """
SELECT c_custkey AS case_id,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 45 AS DOUBLE) END AS stated_count,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(floor(c_acctbal) AS DOUBLE) END AS stated_sum,
       c_nationkey AS nation_code
FROM {customer} WHERE c_custkey % 10 <> 9
"""

# predictions of six models with ties, subgroup sources, split
VIEWS["scores"] = """
SELECT o_orderkey AS case_id, o_orderkey AS base_order, o_custkey AS owner,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS target,
       (200 + o_orderkey * 7919 % 4001) / 99991e0 AS logit_t,
       (200 + o_orderkey * 7907 % 3001 + CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 31 % 2003 ELSE 0 END) / 99991e0
           AS logit_ad,
       (200 + o_orderkey * 7901 % 401 * 10) / 99991e0 AS trees_t,
       (200 + o_orderkey * 7883 % 301 * 10 + CASE WHEN o_orderstatus = 'F' THEN 900 ELSE 0 END) / 99991e0 AS trees_ad,
       (250 + o_orderkey * 7879 % 5003) / 99991e0 AS mlp_t,
       (250 + o_orderkey * 7877 % 4003 + CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 37 % 1009 ELSE 0 END) / 99991e0
           AS mlp_ad,
       CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 6 AS DOUBLE) END AS account_count,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 121) / 2e1 END AS history_years,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS has_debit,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS has_deposit,
       CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS has_tax
FROM {orders}
"""

# feature table: one row per entity, numeric, monetary, sibling and nominal columns
VIEWS["features"] = """
SELECT o_orderkey AS case_id, o_orderkey AS base_order, CAST(o_orderdate AS DATE) AS decision_date,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS target,
       CAST(o_orderkey % 60 + 20 AS DOUBLE) AS t_age,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE floor(o_totalprice) END AS t_income,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey * 17 % 97 AS DOUBLE) END AS t_dpd,
       CASE WHEN o_custkey % 3 = 0 THEN NULL
            ELSE CAST(o_orderkey * 7919 % 20011 - 500 AS DOUBLE) / 4e0 END AS ad_debit_mean,
       CASE WHEN o_custkey % 3 = 0 THEN NULL
            ELSE CAST(o_orderkey * 7919 % 20011 - 500 + o_orderkey % 90 AS DOUBLE) / 4e0 END AS ad_debit_max,
       CASE WHEN o_custkey % 3 = 0 THEN NULL
            ELSE CAST(o_orderkey * 7919 % 20011 - 500 AS DOUBLE) / 4e0 END AS ad_debit_copy,
       CASE WHEN o_custkey % 5 = 1 THEN NULL WHEN o_orderkey % 11 = 0 THEN 0e0
            ELSE CAST(o_orderkey % 1009 AS DOUBLE) END AS ad_deposit_mean,
       CASE WHEN o_custkey % 7 = 2 THEN NULL ELSE CAST(o_orderkey % 6 AS DOUBLE) END AS ad_tax_count,
       CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE o_orderpriority END AS t_priority,
       CASE WHEN md5(CAST(o_orderkey AS STRING)) < '010' THEN concat('R', CAST(o_custkey % 97 AS STRING)) WHEN o_custkey % 2 = 0 THEN 'EVEN'
            ELSE 'ODD' END AS t_kind,
       CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS has_debit,
       CAST(CASE WHEN o_custkey % 5 = 1 THEN 0 ELSE 1 END AS BIGINT) AS has_deposit,
       CAST(CASE WHEN o_custkey % 7 = 2 THEN 0 ELSE 1 END AS BIGINT) AS has_tax
FROM {orders}
"""

# data dictionary: one variable per passage, some blank, duplicated or without description
VIEWS["dictionary"] = """
SELECT item_id,
       CASE WHEN item_id % 19 = 18 THEN ' ' ELSE lower(regexp_extract(text, '([A-Za-z][A-Za-z][A-Za-z][A-Za-z][A-Za-z][A-Za-z]+)', 1)) END AS variable,
       CASE WHEN item_id % 7 = 3 THEN '' ELSE concat('passage ', CAST(item_id AS STRING)) END AS description
FROM {benchmark}
"""
