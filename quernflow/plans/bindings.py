"""The engine's operators bound to the benchmark tables: one query and one SQL text each.

Every query reads whole tables. Dirt, deletes and later versions are derived from the
tables' own columns. Measures are summed as decimals, so sums do not hang on the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernflow import control
from quernflow.functions.columns import digest, rounded
from quernflow.operators import access, asof, calendar, cleanse, dedup, feed, history, quality, reconcile, skew, upsert
from quernflow.plans import facts, views
from quernflow.registry import CDC, FULL, Attribute, Entity, Rule
from quernflow.session import files_for, workspace
from quernflow.sources import extract, landing
from quernflow.sources.versioned import VersionedTable
from quernflow.streaming import telemetry
from quernflow.streaming.silver import SilverProcessor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def plain(column: Column, digits: int = 6) -> Column:
    return rounded(column, digits)


def sql_round(x: str, digits: int = 6) -> str:
    """The SQL twin of ``rounded``."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


# ---------------------------------------------------------------- cleansing and quality

CUSTOMER = Entity(
    "customer_feed", "CRM", FULL, ("cust_id",), ("cust_id",),
    (
        Attribute("CUST_ID", "cust_id", "bigint", ("trim",)), Attribute("NAME", "cust_name", "string", ("trim", "upper", "empty_to_null")),
        Attribute("SEGMENT", "segment", "string", ("trim", "lower", "empty_to_null")), Attribute("BALANCE", "balance", "decimal(12,2)", ("trim",)), Attribute("PHONE", "phone"),
    ),
    {"segment": "unknown"},
    (Rule("cust_id_not_null", "cust_id IS NOT NULL"), Rule("balance_not_negative", "balance >= 0", "WARN")),
)


def messy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.when(F.col("c_nationkey") == 7, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("CUST_ID"),
        F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("NAME"), F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_mktsegment")).alias("SEGMENT"),
        F.when(F.col("c_nationkey") == 3, "n/a").otherwise(money("c_acctbal").cast("string")).alias("BALANCE"), F.lit("dropped").alias("UNDECLARED"),
    )


SQL_CUSTOMERS = """
SELECT CASE WHEN c_nationkey = 7 THEN NULL ELSE c_custkey END AS cust_id, upper(c_name) AS cust_name,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' ELSE lower(c_mktsegment) END AS segment,
       CASE WHEN c_nationkey = 3 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) END AS balance, CAST(NULL AS VARCHAR) AS phone
FROM customer
"""


@query(SQL_CUSTOMERS)
def cleanse_customer(spark, sf_dir):
    """Standardise: string steps, safe casts, renames, defaults, missing and undeclared columns."""
    return cleanse.standardise(messy_customers(spark, sf_dir), CUSTOMER).withColumn("balance", plain(F.col("balance"), 2))


@query(f"""
SELECT coalesce(CAST(cust_id AS VARCHAR), '') AS _sequence, false AS _is_deleted,
       sha256(concat({', '.join(f"coalesce(length({c}) || ':' || {c}, '~')" for c in ("CAST(cust_id AS VARCHAR)", "cust_name", "segment", "printf('%.2f', balance)"))}, '~')) AS _row_hash
FROM ({SQL_CUSTOMERS})
""")
def row_metadata(spark, sf_dir):
    """Sequence, delete flag and row hash of cleansed rows."""
    rows = cleanse.standardise(messy_customers(spark, sf_dir), CUSTOMER)
    return cleanse.add_row_metadata(rows, CUSTOMER, "run").select("_sequence", "_is_deleted", "_row_hash")


LINE_RULES = (
    Rule("tax_not_zero", "l_tax > 0"),
    Rule("discount_in_range", "l_discount BETWEEN 0.0 AND 0.09"),
    Rule("flag_in_domain", "nullif(l_returnflag, 'N') IN ('A', 'R') OR l_linestatus = 'O'"),
    Rule("quantity_usual", "l_quantity <= 40", "WARN"),
)


def sql_failed(alias: str = "") -> tuple[str, str]:
    checks = [(r.name, r.severity, r.check.replace("nullif(l_returnflag, 'N')", "nullif(l_returnflag, 'N')")) for r in LINE_RULES]
    listed = lambda s: ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, sev, c in checks if sev == s)
    return f"concat_ws(',', {listed('ERROR')})", f"concat_ws(',', {listed('WARN')})"


_ERR, _WARN = sql_failed()


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ERR} AS errors, {_WARN} AS warnings, CASE WHEN {_ERR} = '' THEN 'valid' ELSE 'quarantined' END AS part FROM lineitem")
def dq_split(spark, sf_dir):
    """Severity-based split; NULL fails a rule."""
    parts = quality.split(table(spark, sf_dir, "lineitem"), LINE_RULES)
    both = parts.valid.withColumn("part", F.lit("valid")).unionByName(parts.quarantined.withColumn("part", F.lit("quarantined")))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", "_dq_errors").alias("errors"), F.concat_ws(",", "_dq_warnings").alias("warnings"), "part")


@query(" UNION ALL ".join(f"SELECT '{r.name}' AS rule_name, '{r.severity}' AS severity, count(*) FILTER (WHERE NOT coalesce({r.check}, false)) AS failed_count FROM lineitem" for r in LINE_RULES))
def dq_counts(spark, sf_dir):
    """Failures per rule in one pass."""
    return quality.rule_counts(quality.check(table(spark, sf_dir, "lineitem"), LINE_RULES), LINE_RULES)


@query("SELECT l_shipmonth, rule_name, failed_count, severity FROM (" + " UNION ALL ".join(f"SELECT date_trunc('month', l_shipdate)::DATE AS l_shipmonth, '{r.name}' AS rule_name, '{r.severity}' AS severity, count(*) FILTER (WHERE NOT coalesce({r.check}, false)) AS failed_count FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE NOT coalesce({r.check}, false)) >= 30" for r in LINE_RULES) + ")")
def dq_failing(spark, sf_dir):
    """Rules that enough rows of a month fail: a count per group, groups filtered by it."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.to_date(F.date_trunc("month", "l_shipdate")))
    return quality.failing_rules(quality.check(rows, LINE_RULES), LINE_RULES, ["l_shipmonth"], 30)


LINE_KEYS = ("l_orderkey", "l_linenumber")
LINE_TIE = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
SQL_LATEST_LINES = f"""
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {', '.join(f'{c} DESC' for c in LINE_TIE)}) AS rn FROM lineitem) WHERE rn = 1
"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_shipdate AS DATE) AS ship_date FROM ({SQL_LATEST_LINES})")
def dedup_latest(spark, sf_dir):
    """Latest row per key with a full tie-break."""
    rows = dedup.latest(table(spark, sf_dir, "lineitem"), LINE_KEYS, "l_shipdate", LINE_TIE)
    return rows.select(*LINE_KEYS, "l_partkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("ship_date"))


@query(f"""
WITH n AS (SELECT count(*) AS n FROM lineitem), v AS (SELECT * FROM lineitem WHERE {_ERR} = ''),
l AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM v)), c AS (SELECT count(*) AS n FROM v)
SELECT n.n AS read_rows, l.n AS kept_rows, n.n - c.n AS quarantined_rows, c.n - l.n AS duplicate_rows, true AS passed FROM n, l, c
""")
def silver_balance(spark, sf_dir):
    """Rows read = kept + quarantined + duplicates, each counted on its own."""
    rows = table(spark, sf_dir, "lineitem")
    checked = quality.check(rows, LINE_RULES)
    valid = checked.where(F.size("_dq_errors") == 0)
    kept = dedup.latest(valid.select(*rows.columns), LINE_KEYS, "l_shipdate", LINE_TIE)
    read, n_valid, n_kept, n_bad = rows.count(), valid.count(), kept.count(), checked.where(F.size("_dq_errors") > 0).count()
    result = reconcile.silver_balance("lineitem", read, n_kept, n_bad, n_valid - n_kept)
    return spark.createDataFrame([(read, n_kept, n_bad, n_valid - n_kept, result.passed)], "read_rows long, kept_rows long, quarantined_rows long, duplicate_rows long, passed boolean")


# ---------------------------------------------------------------- change application

def order_target(spark, sf_dir) -> DataFrame:
    """Orders known before 2001."""
    o = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ'2001-01-01 00:00:00'")
    return o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit("0x01").alias("_sequence"), F.lit(False).alias("_is_deleted"))


def order_changes(spark, sf_dir) -> DataFrame:
    """Updates, deletes, stale changes and, from 2001 on, new orders."""
    o = table(spark, sf_dir, "orders")
    stale = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    return o.where("o_orderpriority <> '3-MEDIUM'").select(
        "o_orderkey", "o_custkey", F.concat("o_orderstatus", F.lit("2")).alias("status"), F.when(stale, "0x00").otherwise("0x02").alias("_sequence"), (F.col("o_orderpriority") == "1-URGENT").alias("_is_deleted")
    )


SQL_MERGE = """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, '0x01' AS _sequence, false AS _is_deleted FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'),
s AS (SELECT o_orderkey, o_custkey, o_orderstatus || '2' AS status, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '0x00' ELSE '0x02' END AS _sequence, o_orderpriority = '1-URGENT' AS _is_deleted
      FROM orders WHERE o_orderpriority <> '3-MEDIUM'),
m AS (SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, t.o_orderkey AS tk, s.o_orderkey AS sk,
             s.o_orderkey IS NOT NULL AND (t.o_orderkey IS NULL OR s._sequence > t._sequence) AS newer, s._is_deleted AS gone,
             s.o_custkey AS sc, t.o_custkey AS tc, s.status AS ss, t.status AS ts, s._sequence AS sq, t._sequence AS tq, t._is_deleted AS td
      FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey)
"""
_MERGED = "SELECT o_orderkey, CASE WHEN newer THEN sc ELSE tc END AS o_custkey, CASE WHEN newer THEN ss ELSE ts END AS status, CASE WHEN newer THEN sq ELSE tq END AS _sequence, CASE WHEN newer THEN gone ELSE td END AS _is_deleted FROM m"


@query(f"{SQL_MERGE} {_MERGED} WHERE NOT (tk IS NULL AND gone)")
def cdc_apply(spark, sf_dir):
    """Sequence-guarded upsert with soft deletes."""
    return upsert.upsert(order_target(spark, sf_dir), order_changes(spark, sf_dir), ["o_orderkey"])


@query(f"{SQL_MERGE} {_MERGED}")
def cdc_tombstones(spark, sf_dir):
    """The same, with deletes of unknown keys kept as tombstones."""
    return upsert.upsert(order_target(spark, sf_dir), order_changes(spark, sf_dir), ["o_orderkey"], keep_tombstones=True)


@query(f"{SQL_MERGE} {_MERGED} WHERE NOT (newer AND gone)")
def cdc_hard_delete(spark, sf_dir):
    """Upsert that removes deleted keys."""
    return upsert.upsert(order_target(spark, sf_dir), order_changes(spark, sf_dir), ["o_orderkey"], delete_mode="hard")


@query(f"{SQL_MERGE} SELECT count(*) FILTER (WHERE tk IS NULL AND NOT gone) AS inserted, count(*) FILTER (WHERE tk IS NOT NULL AND newer AND NOT gone) AS updated, count(*) FILTER (WHERE tk IS NOT NULL AND newer AND gone) AS soft_deleted, count(*) FILTER (WHERE sk IS NOT NULL AND ((tk IS NULL AND gone) OR (tk IS NOT NULL AND NOT newer))) AS ignored FROM m")
def merge_metrics(spark, sf_dir):
    """Rows inserted, updated, deleted and ignored."""
    return upsert.merge_metrics(order_target(spark, sf_dir), order_changes(spark, sf_dir), ["o_orderkey"])


@query(f"{SQL_MERGE} SELECT sk AS o_orderkey FROM m WHERE sk IS NOT NULL AND ((tk IS NULL AND NOT gone) OR tq < sq)")
def verify_missing(spark, sf_dir):
    """Keys of a batch that the target lacks or has in an older version."""
    return reconcile.missing_or_older(order_changes(spark, sf_dir), order_target(spark, sf_dir), ["o_orderkey"])


def order_versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: low-priority finished orders go, urgent ones move by a day, 2001 is new."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"), money("o_totalprice").alias("price"), "o_orderstatus", "o_orderpriority")
    hashed = lambda df: df.withColumn("_row_hash", digest([F.col(c) for c in ("order_date", "price", "o_orderstatus")])).drop("o_orderpriority")
    before = o.where("order_date < DATE'2001-01-01'")
    after = o.where("NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')").withColumn("order_date", F.when(F.col("o_orderpriority") == "1-URGENT", F.date_add("order_date", 1)).otherwise(F.col("order_date")))
    return hashed(before), hashed(after)


SQL_VERSIONS = """
WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'),
a AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS order_date, o_totalprice AS price FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')),
f AS (
  SELECT b.o_orderkey, b.order_date, b.price, 'delete' AS change_type FROM b LEFT JOIN a USING (o_orderkey) WHERE a.o_orderkey IS NULL
  UNION ALL SELECT a.o_orderkey, a.order_date, a.price, 'insert' FROM a LEFT JOIN b USING (o_orderkey) WHERE b.o_orderkey IS NULL
  UNION ALL SELECT b.o_orderkey, b.order_date, b.price, 'update_preimage' FROM b JOIN a USING (o_orderkey) WHERE a.order_date <> b.order_date
  UNION ALL SELECT a.o_orderkey, a.order_date, a.price, 'update_postimage' FROM b JOIN a USING (o_orderkey) WHERE a.order_date <> b.order_date)
"""


@query(f"{SQL_VERSIONS} SELECT o_orderkey, order_date, {sql_round('price', 2)} AS price, change_type FROM f")
def change_feed(spark, sf_dir):
    """Diff of two snapshots with both images of an update."""
    rows = feed.changes(*order_versions(spark, sf_dir), ["o_orderkey"])
    return rows.select("o_orderkey", "order_date", plain(F.col("price"), 2).alias("price"), F.col("_change_type").alias("change_type"))


@query(f"{SQL_VERSIONS} SELECT DISTINCT order_date AS day FROM f")
def affected_dates(spark, sf_dir):
    """The days that a change feed touches."""
    return feed.affected_dates(feed.changes(*order_versions(spark, sf_dir), ["o_orderkey"]), "order_date")


@query(f"{SQL_VERSIONS} SELECT order_date, count(*) AS orders, {sql_round('sum(CAST(price AS DECIMAL(18,2)))', 2)} AS revenue FROM a GROUP BY order_date")
def merge_replace(spark, sf_dir):
    """A daily fact brought up to date in a table partitioned by year: only touched years are
    written, and in these the touched days come from the changed orders."""
    before, after = order_versions(spark, sf_dir)
    daily = lambda df: df.groupBy("order_date").agg(F.count(F.lit(1)).alias("orders"), F.sum("price").alias("revenue")).withColumn("order_year", F.year("order_date"))
    store = VersionedTable(spark, workspace(spark), ("order_date",), ("order_year",))
    store.replace(daily(before), None)
    days = feed.affected_dates(feed.changes(before, after, ["o_orderkey"]), "order_date")
    years = [r[0] for r in days.select(F.year("day")).distinct().collect()]
    fresh = daily(after.join(days.withColumnRenamed("day", "order_date"), "order_date", "left_semi"))
    store.replace(upsert.replace_dates(store.read(segments=[str(y) for y in years]), fresh, "order_date", days), years)
    return store.read().select("order_date", "orders", plain(F.col("revenue"), 2).alias("revenue"))


@query(f"{SQL_VERSIONS} SELECT o_orderkey, order_date, {sql_round('price', 2)} AS price FROM a")
def publish_collapse(spark, sf_dir):
    """The collapsed feed applied to the older copy gives the newer one."""
    before, after = order_versions(spark, sf_dir)
    collapsed = feed.collapse(feed.changes(before, after, ["o_orderkey"], version=1), ["o_orderkey"])
    return feed.apply_feed(before, collapsed, ["o_orderkey"]).select("o_orderkey", "order_date", plain(F.col("price"), 2).alias("price"))


@query(f"{SQL_VERSIONS} SELECT o_orderkey, order_date, {sql_round('price', 2)} AS price, change_type, version FROM (SELECT f.*, 1 AS version FROM f) UNION ALL SELECT o_orderkey, order_date, {sql_round('price', 2)}, 'snapshot', 0 FROM b")
def versioned_table(spark, sf_dir):
    """Two commits of a versioned table: time travel to the first, recorded changes of the second."""
    before, after = order_versions(spark, sf_dir)
    store = VersionedTable(spark, workspace(spark), ("o_orderkey",))
    store.commit(before, "CREATE")
    store.commit(after, "MERGE", record_changes=True)
    changed = store.changes(0).select("o_orderkey", "order_date", "price", F.col("_change_type").alias("change_type"), F.col("_commit_version").cast("int").alias("version"))
    first = store.read(0).select("o_orderkey", "order_date", "price", F.lit("snapshot").alias("change_type"), F.lit(0).alias("version"))
    return changed.unionByName(first).withColumn("price", plain(F.col("price"), 2))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN old IS NULL THEN 2 ELSE 4 END AS operation, o_orderstatus AS status FROM s UNION ALL SELECT o_custkey, o_orderkey, 3, old FROM s WHERE old IS NOT NULL
""")
def cdc_image_pairs(spark, sf_dir):
    """Before and after images of each customer's status as orders come in."""
    o = table(spark, sf_dir, "orders")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1
    log = o.select("o_custkey", "o_orderdate", "o_orderkey", F.when(first, 2).otherwise(4).alias("cdc_operation"), F.col("o_orderstatus").alias("status"))
    return feed.pair_images(log, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("cdc_operation").alias("operation"), "status")


# ---------------------------------------------------------------- dimensions and as-of

def customer_log(spark, sf_dir) -> DataFrame:
    """A customer's status by order day: the highest status of the day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.to_date("o_orderdate").alias("changed_on")).agg(F.max("o_orderstatus").alias("status"))


SQL_HISTORY = """
WITH log AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS changed_on, max(o_orderstatus) AS status FROM orders GROUP BY 1, 2),
marked AS (SELECT *, lag(status) OVER (PARTITION BY o_custkey ORDER BY changed_on) AS last FROM log),
starts AS (SELECT o_custkey, status, CASE WHEN last IS NULL THEN DATE '1900-01-01' ELSE changed_on END AS effective_from FROM marked WHERE last IS NULL OR last <> status),
dim AS (SELECT o_custkey, status, effective_from, coalesce(lead(effective_from) OVER (PARTITION BY o_custkey ORDER BY effective_from), DATE '9999-12-31') AS effective_to,
               lead(effective_from) OVER (PARTITION BY o_custkey ORDER BY effective_from) IS NULL AS is_current FROM starts)
"""


def customer_history(spark, sf_dir) -> DataFrame:
    return history.scd2_from_log(customer_log(spark, sf_dir), ["o_custkey"], ["status"], "changed_on", "customer_sk")


@query(f"{SQL_HISTORY} SELECT * FROM dim")
def scd2_customer(spark, sf_dir):
    """Type 2 history from a change log; unchanged days make no version."""
    h = customer_history(spark, sf_dir)
    return h.select("o_custkey", "status", F.to_date("effective_from").alias("effective_from"), F.to_date("effective_to").alias("effective_to"), "is_current")


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1, 2),
s AS (SELECT o_custkey, status, make_date(y, 12, 31) AS since, lag(status) OVER (PARTITION BY o_custkey ORDER BY y) AS last FROM y WHERE y <= 1997),
v AS (SELECT o_custkey, status, CASE WHEN last IS NULL THEN DATE '1900-01-01' ELSE since END AS effective_from FROM s WHERE last IS NULL OR last <> status)
SELECT *, coalesce(lead(effective_from) OVER w, DATE '9999-12-31') AS effective_to, lead(effective_from) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY effective_from)
""")
def scd2_batches(spark, sf_dir):
    """The same kind of history by three yearly snapshot merges."""
    o = table(spark, sf_dir, "orders")
    yearly = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    target = None
    for y in (1995, 1996, 1997):
        snapshot = yearly.where(F.col("y") == y).select("o_custkey", "status", F.make_date("y", F.lit(12), F.lit(31)).alias("at"))
        target = history.empty_scd2(snapshot, ["o_custkey"], ["status"], "customer_sk") if target is None else target
        target = history.scd2(target, snapshot, ["o_custkey"], ["status"], "at", "customer_sk")
    return target.select("o_custkey", "status", F.to_date("effective_from").alias("effective_from"), F.to_date("effective_to").alias("effective_to"), "is_current")


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name || ' (debtor)' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN 'changed' ELSE 'same' END AS state FROM supplier WHERE s_nationkey <> 5
UNION ALL SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name || ' (debtor)' ELSE s_name END, 'new' FROM supplier WHERE s_nationkey = 5
""")
def scd1_supplier(spark, sf_dir):
    """Type 1 merge: new suppliers come, changed names are overwritten, the rest keep their row."""
    s = table(spark, sf_dir, "supplier")
    known = s.where("s_nationkey <> 5").select("s_suppkey", "s_name")
    target = history.scd1(known.limit(0).select(F.lit(0).cast("long").alias("sk"), "s_suppkey", "s_name", F.lit("").alias("attr_hash")), known, "s_suppkey", ["s_name"], "sk")
    fresh = s.select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.concat("s_name", F.lit(" (debtor)"))).otherwise(F.col("s_name")).alias("s_name"))
    old = target.select(F.col("s_suppkey").alias("_k"), F.col("attr_hash").alias("_h"))
    merged = history.scd1(target, fresh, "s_suppkey", ["s_name"], "sk").join(old, F.col("s_suppkey") == F.col("_k"), "left")
    state = F.when(F.col("_k").isNull(), "new").when(F.col("_h") == F.col("attr_hash"), "same").otherwise("changed")
    return merged.select("s_suppkey", "s_name", state.alias("state"))


@query(f"{SQL_HISTORY} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o.o_custkey, coalesce(d.status, 'miss') AS status, d.o_custkey IS NOT NULL AS found FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN dim d ON d.o_custkey = o.o_custkey AND CAST(l.l_shipdate AS DATE) >= d.effective_from AND CAST(l.l_shipdate AS DATE) < d.effective_to")
def asof_join(spark, sf_dir):
    """The customer version in force on the ship day; a miss has key -1."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("at", F.to_date("l_shipdate").cast("timestamp"))
    joined = asof.version_in_force(rows, customer_history(spark, sf_dir), "o_custkey", "at", "o_custkey", "customer_sk", ("status",))
    return joined.select(*LINE_KEYS, "l_partkey", "l_suppkey", "l_quantity", "o_custkey", F.coalesce("status", F.lit("miss")).alias("status"), (F.col("customer_sk") != -1).alias("found"))


@query("""
SELECT e.event_id, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS o_orderkey
FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id
""")
def asof_sorted(spark, sf_dir):
    """Each event with its user's latest earlier order, by one sort per key."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("since")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return asof.asof_sorted(e, o, "user_id", "ts", "since", "o_orderkey").select("event_id", "o_orderkey")


_DOW = "dayofweek(d) + 1"


@query(f"""
SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS calendar_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, monthname(d) AS month_name,
       CAST(weekofyear(d) AS INT) AS iso_week, CAST({_DOW} AS INT) AS day_of_week, dayname(d) AS day_name, {_DOW} IN (1, 7) AS is_weekend, 'FY' || (year(d) + CASE WHEN month(d) >= 4 THEN 1 ELSE 0 END) AS fiscal_year
FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
""")
def dim_date(spark, sf_dir):
    """The generated calendar."""
    return calendar.dim_date(spark)


@query("SELECT r_regionkey AS k, r_name AS name, false AS is_unknown FROM region UNION ALL SELECT -1, 'UNKNOWN', true")
def unknown_member(spark, sf_dir):
    """A dimension with its unknown member."""
    d = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))
    return history.with_unknown(d, "k").select(F.col("k").cast("int").alias("k"), "name", (F.col("k") == -1).alias("is_unknown"))


# ---------------------------------------------------------------- facts

SQL_FACT = """
WITH base AS (SELECT CAST(l_shipdate AS DATE) AS production_date, l_suppkey, l_partkey, count(*) AS production_runs, CAST(sum(l_quantity) AS BIGINT) AS units_produced,
                     CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS units_scrapped, sum(CAST(l_quantity AS DECIMAL(12,2)) * 3) AS run_minutes FROM lineitem GROUP BY 1, 2, 3),
q AS (SELECT CAST(l_shipdate AS DATE) AS production_date, l_suppkey, l_partkey, count(*) AS inspections, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed_inspections
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3),
fact AS (SELECT base.*, units_produced - units_scrapped AS units_good, coalesce(inspections, 0) AS inspections, coalesce(failed_inspections, 0) AS failed_inspections FROM base LEFT JOIN q USING (production_date, l_suppkey, l_partkey))
"""


@dataclass(frozen=True)
class Floor:
    """The benchmark tables as the engine's silver tables and dimensions: a line is a run of its
    supplier's machine, lines of urgent orders are inspected, failed inspections stop the machine."""

    runs: DataFrame
    inspections: DataFrame
    work_orders: DataFrame
    machines: DataFrame
    products: DataFrame
    plants: DataFrame


def known(df: DataFrame, key: str = "production_log_id") -> DataFrame:
    """With the row metadata of silver."""
    return df.withColumns({"_is_deleted": F.lit(False), "_sequence": F.lit("1"), "_row_hash": digest([F.col(c) for c in df.columns])})


def floor(spark, sf_dir) -> Floor:
    lines = table(spark, sf_dir, "lineitem")
    start, quantity = F.to_date("l_shipdate").cast("timestamp"), F.col("l_quantity").cast("int")
    lines = lines.withColumn("production_log_id", F.xxhash64(*lines.columns)).withColumns({"machine_id": F.col("l_suppkey").cast("string"), "product_id": F.col("l_partkey").cast("string")})
    runs = lines.select(
        "production_log_id", "machine_id", "product_id", start.alias("start_ts"), F.timestamp_seconds(F.unix_seconds(start) + quantity * 180).alias("end_ts"), quantity.alias("units_produced"),
        F.when(F.col("l_returnflag") == "R", quantity).otherwise(0).alias("units_scrapped"), "l_orderkey",
    )
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select("o_orderkey", "o_orderstatus")
    checked = runs.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"))
    failed = F.col("o_orderstatus") == "F"
    inspections = checked.select(
        F.col("production_log_id").alias("inspection_id"), "production_log_id", "machine_id", "product_id", F.col("end_ts").alias("inspection_ts"), F.lit(20).alias("sample_size"), F.when(failed, 3).otherwise(0).alias("defect_count"),
        F.when(failed, "FAIL").otherwise("PASS").alias("inspection_result"), F.lit("NONE").alias("defect_code"), F.lit("i").alias("inspector_id"),
    )
    stops = checked.where(failed).select(
        F.col("production_log_id").cast("string").alias("work_order_id"), "machine_id", F.lit("BREAKDOWN").alias("work_type"), F.lit("P1").alias("priority"), F.lit("COMPLETED").alias("status"), F.col("start_ts").alias("reported_at"),
        F.col("start_ts").alias("started_at"), F.col("end_ts").alias("completed_at"), F.lit(200).alias("downtime_minutes"), F.lit("t").alias("technician"),
    )
    long_ago, later = F.lit("1995-01-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp")
    p = table(spark, sf_dir, "part")
    base = p.select(
        F.col("p_partkey").cast("string").alias("product_id"), "p_type", F.col("p_name").alias("product_name"), F.concat(F.lit("SKU"), "p_partkey").alias("sku"), F.col("p_brand").alias("product_family"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("unit_cost"), (F.col("p_size") + 10).alias("std_cycle_time_sec"), long_ago.alias("last_update_date"),
    )
    slower = base.where("p_type = 'ECONOMY'").withColumns({"std_cycle_time_sec": F.col("std_cycle_time_sec") + 15, "last_update_date": later})
    products = facts.dim_product(history.empty_scd2(base, ["product_id"], facts.PRODUCT, "product_sk"), base)
    products = facts.dim_product(products, slower)
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("machine_id"), F.col("s_name").alias("machine_name"), F.concat(F.lit("N"), "s_nationkey").alias("plant_id"), F.lit("L1").alias("line_id"), F.lit("PRESS").alias("machine_type"), F.lit("m").alias("manufacturer"),
        F.lit("1990-01-01").cast("date").alias("install_date"), F.lit("ACTIVE").alias("status"), F.lit(100).alias("rated_units_per_hour"), F.lit(False).alias("_is_deleted"), long_ago.alias("source_modified_at"),
    )
    machines = facts.dim_machine(history.empty_scd2(s.withColumn("is_source_deleted", F.lit(False)), ["machine_id"], facts.MACHINE, "machine_sk"), s)
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("plant_id"), F.col("n_name").alias("plant_name"), F.lit("c").alias("city"), F.lit("at").alias("country_code"), F.lit("UTC").alias("timezone"))
    none = n.limit(0).select(F.lit(0).cast("long").alias("plant_sk"), "plant_id", *facts.PLANT, F.lit("").alias("attr_hash"))
    return Floor(known(runs.drop("l_orderkey")), known(inspections), known(stops), machines, products, facts.dim_plant(none, n))


def production(f: Floor) -> DataFrame:
    return facts.production_daily(f.runs, f.inspections, f.machines, f.products, f.plants)


def daily(spark, sf_dir) -> DataFrame:
    """Day x supplier x part by the production fact."""
    out = production(floor(spark, sf_dir))
    return out.select(
        "production_date", F.col("machine_id").cast("long").alias("l_suppkey"), F.col("product_id").cast("long").alias("l_partkey"), "production_runs", "units_produced", "units_scrapped", "units_good", "run_minutes", "ideal_units",
        "inspections", "sampled_units", "defect_units", "failed_inspections",
    )


@query(f"{SQL_FACT} SELECT * REPLACE ({sql_round('run_minutes', 2)} AS run_minutes) FROM fact")
def fact_daily(spark, sf_dir):
    """Production by day, supplier and part with its inspections."""
    return daily(spark, sf_dir).drop("ideal_units", "sampled_units", "defect_units").withColumn("run_minutes", plain(F.col("run_minutes"), 2))


SQL_OEE = f"""{SQL_FACT},
ideal AS (SELECT f.*, CAST(floor(CAST(run_minutes * 60 AS DECIMAL(20,2)) / (p_size + CASE WHEN p_type = 'ECONOMY' AND production_date >= DATE '1998-01-01' THEN 25 ELSE 10 END)) AS BIGINT) AS ideal_units FROM fact f JOIN part ON l_partkey = p_partkey),
m AS (SELECT production_date, l_suppkey, sum(units_produced)::BIGINT AS units_produced, sum(units_good)::BIGINT AS units_good, sum(ideal_units)::BIGINT AS ideal_units, sum(failed_inspections)::BIGINT * 200 AS downtime_minutes FROM ideal GROUP BY 1, 2),
c AS (SELECT *, 1440 AS planned_minutes, greatest(0, 1440 - downtime_minutes) AS available_minutes FROM m),
o AS (SELECT *, {sql_round('available_minutes / planned_minutes', 4)} AS availability, {sql_round('least(1.0, units_produced / nullif(ideal_units, 0))', 4)} AS performance, {sql_round('units_good / nullif(units_produced, 0)', 4)} AS quality FROM c),
oee AS (SELECT *, {sql_round('availability * performance * quality', 4)} AS oee FROM o)
"""


def machine_days(spark, sf_dir) -> DataFrame:
    """Day x supplier by the machine fact."""
    f = floor(spark, sf_dir)
    out = facts.machine_daily(production(f), f.work_orders, f.machines, f.plants)
    return out.withColumn("l_suppkey", F.col("machine_id").cast("long"))


@query(f"{SQL_OEE} SELECT production_date, l_suppkey, units_produced, units_good, ideal_units, downtime_minutes, planned_minutes, available_minutes, availability, performance, quality, oee FROM oee")
def fact_effectiveness(spark, sf_dir):
    """Availability, performance, quality and OEE by day and supplier, with as-of cycle times."""
    names = ("production_date", "l_suppkey", "units_produced", "units_good", "ideal_units", "downtime_minutes", "planned_minutes", "available_minutes", "availability", "performance", "quality", "oee")
    return machine_days(spark, sf_dir).select(*names)


def intervals(spark, sf_dir) -> DataFrame:
    """A six-hour run on a user's clock for each order."""
    o = table(spark, sf_dir, "orders")
    start = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("o_orderkey") * 7919, F.lit(29 * 24)) * 3600)
    users = table(spark, sf_dir, "events").agg(F.max("user_id") + 1).scalar()
    return o.select("o_orderkey", F.pmod("o_custkey", users).alias("user_id"), start.alias("start_ts"), (start + F.expr("INTERVAL 6 HOURS")).alias("end_ts"))


def exact_readings(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "value", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("event_ts"))


SQL_RUNS = """
WITH u AS (SELECT max(user_id) + 1 AS n FROM events),
r AS (SELECT o_orderkey, o_custkey % n AS user_id, TIMESTAMP '2024-01-01' + to_hours(CAST((o_orderkey * 7919) % (29 * 24) AS INT)) AS start_ts FROM orders, u),
j AS (SELECT o_orderkey, event_type, value FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.start_ts AND e.ts <= r.start_ts + INTERVAL 6 HOURS)
SELECT o_orderkey, event_type, count(*) AS reading_count, CAST(CAST(avg(value) AS DECIMAL(12,3)) AS DOUBLE) AS avg_value, CAST(CAST(min(value) AS DECIMAL(12,3)) AS DOUBLE) AS min_value,
       CAST(CAST(max(value) AS DECIMAL(12,3)) AS DOUBLE) AS max_value, CAST(CAST(stddev_samp(value) AS DECIMAL(12,3)) AS DOUBLE) AS stddev_value FROM j GROUP BY 1, 2
"""


def run_statistics(spark, sf_dir, salts: int = 0) -> DataFrame:
    """The run fact over users as machines and orders as runs."""
    r = intervals(spark, sf_dir).select(F.col("o_orderkey").alias("production_log_id"), F.col("user_id").cast("string").alias("machine_id"), F.lit("p").alias("product_id"), "start_ts", "end_ts", F.lit(False).alias("_is_deleted"))
    e = exact_readings(spark, sf_dir).select(F.col("user_id").cast("string").alias("machine_id"), F.col("event_type").alias("sensor_type"), F.col("value").alias("reading_value"), "event_ts", F.to_date("event_ts").alias("event_date"))
    out = facts.process_run_sensor(r, e, salts=salts)
    return out.select(F.col("production_log_id").alias("o_orderkey"), F.col("sensor_type").alias("event_type"), "reading_count", *[F.col(c).cast("double").alias(c) for c in ("avg_value", "min_value", "max_value", "stddev_value")])


@query(SQL_RUNS)
def run_stats(spark, sf_dir):
    """Reading statistics inside closed intervals: machine and time slice, then the exact range."""
    return run_statistics(spark, sf_dir)


@query(SQL_RUNS)
def run_stats_salted(spark, sf_dir):
    """The same with the keys salted."""
    return run_statistics(spark, sf_dir, 4)


@query("SELECT n_name, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM (SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE c_nationkey END AS k, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey) JOIN nation ON k = n_nationkey GROUP BY 1")
def salted_join(spark, sf_dir):
    """A join on a hot key: two market segments are booked on nation 0."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hot = o.select(F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 0).otherwise(F.col("c_nationkey")).alias("n_nationkey"), "o_orderkey", "o_orderstatus")
    joined = skew.salted_join(hot, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 8)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("""
WITH c AS (SELECT l_suppkey, count(*) AS row_count FROM lineitem GROUP BY 1), m AS (SELECT quantile_disc(row_count, 0.5) AS middle FROM c)
SELECT l_suppkey, row_count, row_count / middle AS times_median FROM c, m ORDER BY row_count DESC, l_suppkey LIMIT 20
""")
def skew_report(spark, sf_dir):
    """The heaviest keys against the median key; the error is small enough to be none here."""
    return skew.skew_report(table(spark, sf_dir, "lineitem"), ["l_suppkey"], error=0.0001)


# ---------------------------------------------------------------- reconciliation and control

SQL_MANIFESTS = """
WITH landed AS (SELECT 'orders_' || year(o_orderdate) AS run_id, count(*) AS landed_rows FROM orders GROUP BY 1),
manifests AS (SELECT run_id, landed_rows + CASE WHEN run_id = 'orders_1999' THEN 5 ELSE 0 END AS rows_copied FROM landed UNION ALL SELECT 'orders_2099', 3)
"""


@query(f"{SQL_MANIFESTS} SELECT m.run_id, m.rows_copied, coalesce(l.landed_rows, 0) AS landed_rows, m.rows_copied = coalesce(l.landed_rows, 0) AS passed FROM manifests m LEFT JOIN landed l USING (run_id) WHERE m.run_id <> 'orders_1995'")
def manifest_recon(spark, sf_dir):
    """Manifests against landed rows; passed runs are left out, one is overstated, one never landed."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders_"), F.year("o_orderdate")).alias("_ingestion_run_id"))
    counts = o.groupBy(F.col("_ingestion_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    manifests = counts.select("run_id", (F.col("n") + F.when(F.col("run_id") == "orders_1999", 5).otherwise(0)).alias("rows_copied"))
    manifests = manifests.unionByName(spark.range(1).select(F.lit("orders_2099").alias("run_id"), F.lit(3).cast("long").alias("rows_copied")))
    passed = spark.range(1).select(F.lit("orders_1995").alias("run_id"))
    return reconcile.manifest_gaps(manifests, o, passed).select("run_id", "rows_copied", "landed_rows", "passed")


@query("""
WITH a AS (SELECT o_orderstatus AS entity, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1)
SELECT entity, n AS source_rows, n - CASE WHEN entity = 'P' THEN 1 ELSE 0 END AS target_rows, entity <> 'P' AS passed FROM a
""")
def amount_recon(spark, sf_dir):
    """Counts and amounts per status; one row is lost on purpose in one of them."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", money("o_totalprice").alias("price"))
    per = lambda df: {r["o_orderstatus"]: (r["n"], float(r["a"])) for r in df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("a")).collect()}
    first = o.where("o_orderstatus = 'P'").agg(F.min("o_orderkey").alias("lost"))
    source, target = per(o), per(o.join(F.broadcast(first), F.col("o_orderkey") == F.col("lost"), "left_anti"))
    results = [reconcile.compare_counts_and_amounts(s, source[s], target.get(s, (0, 0.0)), rel_tol=0.0001) for s in sorted(source)]
    return spark.createDataFrame([(r.entity, source[r.entity][0], target.get(r.entity, (0, 0.0))[0], r.passed) for r in results], "entity string, source_rows long, target_rows long, passed boolean")


@query("""
SELECT event_type AS check_type, user_id AS entity, 'r' AS run_id, arg_max(value < 100, (ts, event_id)) AS passed FROM events GROUP BY 1, 2
""")
def latest_results(spark, sf_dir):
    """The last result of each check; an earlier failure that was repaired does not count."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("check_type"), F.col("user_id").alias("entity"), F.lit("r").alias("run_id"), (F.col("value") < 100).alias("passed"), F.struct("ts", "event_id").alias("checked_at"))
    return reconcile.latest_results(rows).drop("checked_at")


@query("""
SELECT event_type AS check_type, CAST(user_id AS VARCHAR) AS entity, 'r' || (event_id % 3) AS run_id, arg_max(value < 100, ts) AS passed FROM events WHERE ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3
""")
def latest_day_results(spark, sf_dir):
    """The last result of each check and run on one day; the run is read from the detail text."""
    e = table(spark, sf_dir, "events")
    detail = F.concat(F.lit("rows=5; run_id=r"), (F.col("event_id") % 3).cast("string"), F.lit("; ok"))
    rows = e.select(F.col("event_type").alias("check_type"), F.col("user_id").cast("string").alias("entity"), (F.col("value") < 100).alias("passed"), detail.alias("detail"), F.col("ts").cast("timestamp").alias("checked_at"))
    return reconcile.latest_results(reconcile.with_run_id(rows), "2024-01-20 00:00:00").select("check_type", "entity", "run_id", "passed")


@query("SELECT event_type AS layer, user_id AS entity, max(ts) = max(ts) AS there, arg_max(event_id, (ts, event_id)) AS run_id FROM events GROUP BY 1, 2")
def latest_status(spark, sf_dir):
    """The last log entry of each layer and entity."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.col("user_id").alias("entity"), F.col("ts").alias("ended_at"), F.col("event_id").alias("run_id"))
    return control.latest_status(e).select("layer", "entity", F.col("ended_at").isNotNull().alias("there"), "run_id")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS batch_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
       CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'SUCCESS' WHEN count(*) FILTER (WHERE o_orderstatus <> 'F') > 0 THEN 'PARTIAL_FAILURE' ELSE 'FAILED' END AS status FROM orders GROUP BY 1
""")
def batch_status(spark, sf_dir):
    """Roll-up of run results to a batch status."""
    o = table(spark, sf_dir, "orders")
    return control.batch_status(o.select(F.col("o_custkey").cast("string").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCESS").alias("status")))


@query("SELECT c_custkey AS entity, c_nationkey AS priority FROM customer c WHERE c_mktsegment <> 'FURNITURE' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def pending_entities(spark, sf_dir):
    """Enabled entities without a success that day."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("priority"), (F.col("c_mktsegment") != "FURNITURE").alias("enabled"), F.lit("DAILY").alias("batch_group"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("status"), F.lit("2024-01-01").alias("day"))
    return control.pending_entities(c, runs, "DAILY", "2024-01-01").select("entity", "priority")


@query("SELECT c.c_custkey AS entity, r.o_orderkey AS run_id, r.o_orderstatus AS status FROM customer c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) r ON r.o_custkey = c.c_custkey")
def ingestion_status(spark, sf_dir):
    """Each entity with its latest run, if any."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.lit("DAILY").alias("batch_group"), F.lit("").alias("watermark"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.lit("").alias("window_start"), F.lit("").alias("window_end"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("number"))
    return control.ingestion_status(c, runs).select("entity", "run_id", "status")


@query("SELECT 'lsn' AS kind, o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-30' AND o_orderdate <= TIMESTAMP '1999-06-30' UNION ALL SELECT 'watermark', o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-30' AND o_orderdate <= TIMESTAMP '1999-06-30' UNION ALL SELECT 'full', o_orderkey FROM orders")
def extract_windows(spark, sf_dir):
    """The three extraction windows: LSN range, watermark range, everything."""
    o = table(spark, sf_dir, "orders")
    lsn = lambda day: F.concat(F.lit("0x"), F.lpad(F.date_format(day, "yyyyMMdd"), 20, "0"))
    log = o.select("o_orderkey", lsn(F.col("o_orderdate")).alias("cdc_start_lsn"))
    fixed = lambda day: "0x" + day.replace("-", "").rjust(20, "0")
    a = extract.lsn_window(log, fixed("1997-06-30"), fixed("1999-06-30")).select(F.lit("lsn").alias("kind"), "o_orderkey")
    b = extract.watermark_window(o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_orderdate", "1997-06-30 00:00:00", "1999-06-30 00:00:00")
    return a.unionByName(b.select(F.lit("watermark").alias("kind"), "o_orderkey")).unionByName(o.select(F.lit("full").alias("kind"), "o_orderkey"))


# ---------------------------------------------------------------- views and measures

@query(f"""{SQL_OEE} SELECT production_date, n_name, count(DISTINCT l_suppkey) AS machines, sum(units_produced)::BIGINT AS units_produced, {sql_round('sum(available_minutes) / sum(planned_minutes)')} AS availability,
{sql_round('CASE WHEN sum(ideal_units) > 0 THEN least(1.0, sum(units_produced) / sum(ideal_units)) END')} AS performance, {sql_round('sum(units_good) / nullif(sum(units_produced), 0)')} AS quality,
{sql_round('sum(available_minutes) / sum(planned_minutes) * CASE WHEN sum(ideal_units) > 0 THEN least(1.0, sum(units_produced) / sum(ideal_units)) END * (sum(units_good) / nullif(sum(units_produced), 0))')} AS oee
FROM oee JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def oee_rollup(spark, sf_dir):
    """Plant OEE: ratios re-derived from summed components."""
    f = floor(spark, sf_dir)
    out = views.plant_oee_daily(facts.machine_daily(production(f), f.work_orders, f.machines, f.plants), f.plants)
    return out.select("production_date", F.col("plant_name").alias("n_name"), "machines", "units_produced", *[plain(F.col(c)).alias(c) for c in ("availability", "performance", "quality", "oee")])


@query(f"""{SQL_OEE}, last AS (SELECT max(production_date) AS d FROM oee),
a AS (SELECT user_id AS k, count(*) FILTER (WHERE value > 250) AS anomaly_minutes FROM events GROUP BY 1),
w AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' AND l_linestatus = 'O' AND l_tax = 0.08 AND l_linenumber > 6 GROUP BY 1)
SELECT s_suppkey, s_name, coalesce(n, 0) AS open_orders, CASE WHEN coalesce(n, 0) > 0 THEN 'RED' WHEN CASE WHEN o.l_suppkey IS NOT NULL THEN coalesce(a.anomaly_minutes, 0) END > 30 OR o.oee < 0.60 THEN 'AMBER' ELSE 'GREEN' END AS status
FROM supplier LEFT JOIN (SELECT oee.* FROM oee, last WHERE production_date = d) o ON s_suppkey = l_suppkey LEFT JOIN w ON w.k = s_suppkey LEFT JOIN a ON a.k = s_suppkey""")
def status_rag(spark, sf_dir):
    """The shop floor on the last day: open urgent orders, then sensor alarms or a low OEE."""
    f = floor(spark, sf_dir)
    made = production(f)
    last = made.agg(F.max("production_date")).first()[0]
    e = table(spark, sf_dir, "events")
    minutes = e.select(F.lit(last).alias("event_date"), F.col("user_id").cast("string").alias("machine_id"), F.col("ts").alias("window_start"), F.lit("temperature").alias("sensor_type"), F.col("value").alias("avg_value"), F.col("value").alias("max_value"), (F.col("value") > 250).alias("is_anomaly"))
    days = facts.machine_daily(made, f.work_orders, f.machines, f.plants, minutes, [last])
    urgent = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey")
    late = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' AND l_tax = 0.08 AND l_linenumber > 6").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"))
    open_ = late.select(F.col("l_suppkey").cast("string").alias("machine_id"), F.lit("OPEN").alias("status"))
    out = views.shop_floor_status(f.machines, days, open_, str(last))
    return out.select(F.col("machine_id").cast("long").alias("s_suppkey"), F.col("machine_name").alias("s_name"), F.col("open_work_orders").alias("open_orders"), "status")


@query(f"{SQL_FACT} SELECT production_date, p_brand, sum(units_scrapped)::BIGINT AS units_scrapped, CAST(sum(units_scrapped * CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS scrap_cost FROM fact JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def scrap_cost(spark, sf_dir):
    """Scrap at unit cost."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_sk"), F.col("p_retailprice").cast("decimal(12,2)").alias("unit_cost"), F.col("p_brand").alias("product_family"))
    out = views.scrap_cost_daily(daily(spark, sf_dir).withColumnRenamed("l_partkey", "product_sk"), p)
    return out.select("production_date", F.col("product_family").alias("p_brand"), "units_scrapped", F.col("scrap_cost").cast("double").alias("scrap_cost"))


@query(f"""{SQL_OEE}, made AS (SELECT date_trunc('month', production_date)::DATE AS month, sum(units_produced)::BIGINT AS units_produced, sum(units_good)::BIGINT AS units_good, sum(units_scrapped)::BIGINT AS units_scrapped, sum(inspections) AS i, sum(failed_inspections) AS f FROM fact GROUP BY 1),
t AS (SELECT date_trunc('month', production_date)::DATE AS month, sum(planned_minutes) AS p, sum(downtime_minutes) AS d FROM oee GROUP BY 1),
b AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS delivered, count(*) FILTER (WHERE o_orderstatus = 'F') AS rejected FROM orders GROUP BY 1)
SELECT made.month, units_produced, units_good, units_scrapped, {sql_round('units_scrapped / nullif(units_produced, 0)')} AS scrap_rate, {sql_round('1 - f / nullif(i, 0)')} AS first_pass_yield, {sql_round('1 - d / nullif(p, 0)')} AS availability, {sql_round('rejected / nullif(delivered, 0)')} AS supplier_reject_rate
FROM made LEFT JOIN t USING (month) LEFT JOIN b USING (month)""")
def exec_monthly(spark, sf_dir):
    """Monthly figures of production, machine time and deliveries."""
    d = daily(spark, sf_dir).withColumns({"sampled_units": F.col("inspections"), "defect_units": F.col("failed_inspections")})
    bought = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("production_date"), F.lit(1).alias("delivered_qty"), (F.col("o_orderstatus") == "F").cast("int").alias("rejected_qty"))
    out = views.exec_monthly(d, machine_days(spark, sf_dir), bought)
    return out.select("month", "units_produced", "units_good", "units_scrapped", *[plain(F.col(c)).alias(c) for c in ("scrap_rate", "first_pass_yield", "availability", "supplier_reject_rate")])


@query(f"""{SQL_FACT}, ran AS (SELECT date_trunc('month', production_date)::DATE AS month, CAST(l_suppkey AS VARCHAR) AS machine_id, sum(run_minutes) AS run_minutes FROM fact GROUP BY 1, 2),
broke AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS machine_id, count(*) AS breakdowns, sum(30 + o_orderkey % 90) AS repair FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1, 2)
SELECT month, machine_id, CAST(run_minutes AS DOUBLE) AS run_minutes, coalesce(breakdowns, 0) AS breakdowns, {sql_round('CAST(run_minutes AS DOUBLE) / nullif(breakdowns, 0) / 60')} AS mtbf_hours, {sql_round('repair / nullif(breakdowns, 0)')} AS mttr_minutes FROM ran LEFT JOIN broke USING (month, machine_id)""")
def mtbf_mttr(spark, sf_dir):
    """Time between failures and time to repair by month and machine."""
    made = daily(spark, sf_dir).withColumn("machine_id", F.col("l_suppkey").cast("string"))
    n = table(spark, sf_dir, "supplier").count()
    o = table(spark, sf_dir, "orders")
    events = o.select(
        F.pmod("o_custkey", F.lit(n)).cast("string").alias("machine_id"), F.col("o_orderdate").alias("reported_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "BREAKDOWN").otherwise("PREVENTIVE").alias("work_type"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("OPEN").alias("status"), (F.col("o_orderkey") % 90 + 30).alias("repair_minutes"),
    )
    out = views.mtbf_mttr_monthly(made, events)
    return out.select("month", "machine_id", F.col("run_minutes").cast("double").alias("run_minutes"), "breakdowns", plain(F.col("mtbf_hours")).alias("mtbf_hours"), plain(F.col("mttr_minutes")).alias("mttr_minutes"))


@query(f"""WITH s AS (SELECT p_brand, count(*) AS occurrences, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY total DESC, p_brand) AS INT) AS rank, {sql_round('sum(total) OVER (ORDER BY total DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(total) OVER ()')} AS cumulative_share FROM s""")
def pareto(spark, sf_dir):
    """Returned units by brand with the cumulative share."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey", F.col("l_quantity").cast("long").alias("q"))  # noqa: E741
    rows = l.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return views.pareto(rows, "p_brand", "q").withColumn("cumulative_share", plain(F.col("cumulative_share")))


@query(f"SELECT date_trunc('month', l_shipdate)::DATE AS month, s_suppkey, s_name, CAST(sum(l_quantity) AS BIGINT) AS delivered_qty, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS rejected_qty, {sql_round('sum(CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN l_quantity ELSE 0 END) / sum(l_quantity)')} AS reject_rate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3")
def reject_rate(spark, sf_dir):
    """Supplier reject rate by month."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    d = l.select(F.col("l_suppkey").alias("supplier_sk"), F.to_date("l_shipdate").alias("production_date"), F.col("l_quantity").cast("long").alias("delivered_qty"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0).alias("rejected_qty"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_sk"), F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"))
    out = views.reject_rate_monthly(d, s)
    return out.select("month", F.col("supplier_id").alias("s_suppkey"), F.col("supplier_name").alias("s_name"), "delivered_qty", "rejected_qty", plain(F.col("reject_rate")).alias("reject_rate"))


@query(f"""{SQL_FACT}, d AS (SELECT production_date, sum(units_produced)::BIGINT AS units_produced FROM fact GROUP BY 1)
SELECT a.production_date, a.units_produced, sum(a.units_produced) OVER (PARTITION BY date_trunc('month', a.production_date) ORDER BY a.production_date)::BIGINT AS mtd, sum(a.units_produced) OVER (PARTITION BY date_trunc('year', a.production_date) ORDER BY a.production_date)::BIGINT AS ytd,
       b.units_produced AS py, {sql_round('(a.units_produced - b.units_produced) / nullif(b.units_produced, 0)')} AS yoy
FROM d a LEFT JOIN d b ON CAST(b.production_date + INTERVAL 1 YEAR AS DATE) = a.production_date AND day(b.production_date) = day(a.production_date)""")
def ytd_mtd_py(spark, sf_dir):
    """Month and year to date, prior year and change."""
    d = daily(spark, sf_dir).groupBy("production_date").agg(F.sum("units_produced").alias("units_produced"))
    out = views.running_total(views.time_intelligence(d), "production_date", "units_produced", ("year",))
    return out.select("production_date", "units_produced", F.col("units_produced_month_to_date").alias("mtd"), F.col("units_produced_year_to_date").alias("ytd"), F.col("units_produced_py").alias("py"), plain(F.col("units_produced_yoy")).alias("yoy"))


@query(f"""{SQL_OEE}, d AS (SELECT production_date, sum(available_minutes)::BIGINT AS a, sum(planned_minutes)::BIGINT AS p, sum(units_produced)::BIGINT AS u, sum(ideal_units)::BIGINT AS i, sum(units_good)::BIGINT AS g FROM oee GROUP BY 1),
r AS (SELECT production_date, sum(a) OVER w AS a, sum(p) OVER w AS p, sum(u) OVER w AS u, sum(i) OVER w AS i, sum(g) OVER w AS g FROM d WINDOW w AS (ORDER BY production_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
SELECT production_date, u::BIGINT AS units_7d, {sql_round('(a / p) * CASE WHEN i > 0 THEN least(1.0, u / i) END * (g / nullif(u, 0))')} AS oee_7d FROM r""")
def rolling_7d(spark, sf_dir):
    """OEE over the last seven calendar days, from summed components."""
    return views.oee_7d(machine_days(spark, sf_dir)).select("production_date", F.col("units_produced_7d").alias("units_7d"), plain(F.col("oee_7d")).alias("oee_7d"))


_M = {
    "Scrap Rate %": "units_scrapped / nullif(units_produced, 0)", "Run Hours": "CAST(run_minutes AS DOUBLE) / 60", "Inspection Fail Rate %": "failed_inspections / nullif(inspections, 0)", "Units Produced": "units_produced", "Good Units": "units_good",
    "Scrapped Units": "units_scrapped", "Production Runs": "production_runs", "Ideal Units": "ideal_units", "Sampled Units": "inspections * 20", "Defect Units": "failed_inspections * 3", "First Pass Yield %": "1 - failed_inspections * 3 / nullif(inspections * 20, 0)",
    "Defects PPM": "failed_inspections * 3 / nullif(inspections * 20, 0) * 1000000", "Scrap Cost": "scrap_cost",
}
_MACHINE = {
    "Planned Minutes": "planned", "Downtime Minutes": "down", "Availability %": "avail / planned", "Performance %": "CASE WHEN ideal > 0 THEN least(1.0, made / ideal) END", "Quality %": "good / nullif(made, 0)",
    "OEE %": "avail / planned * CASE WHEN ideal > 0 THEN least(1.0, made / ideal) END * (good / nullif(made, 0))", "OEE Target": "0.85", "OEE vs Target": "avail / planned * CASE WHEN ideal > 0 THEN least(1.0, made / ideal) END * (good / nullif(made, 0)) - 0.85", "Sensor Anomaly Minutes": "alarms",
}


def measured(out: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return out.select(*by, *[plain(F.col(f"`{n}`")).alias(n) for n in names])


def listed(formulas: dict[str, str]) -> str:
    return ", ".join(f'{sql_round(x)} AS "{n}"' for n, x in formulas.items())


@query(f"""{SQL_OEE}, s AS (SELECT date_trunc('year', production_date)::DATE AS year, p_brand, sum(units_produced)::BIGINT AS units_produced, sum(units_good)::BIGINT AS units_good, sum(units_scrapped)::BIGINT AS units_scrapped, sum(production_runs)::BIGINT AS production_runs,
sum(run_minutes) AS run_minutes, sum(inspections) AS inspections, sum(failed_inspections) AS failed_inspections, sum(ideal_units) AS ideal_units, sum(units_scrapped * CAST(p_retailprice AS DECIMAL(12,2))) AS scrap_cost, max(production_date) AS data_as_of FROM ideal JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT year, p_brand, data_as_of, {listed(_M)} FROM s""")
def measures(spark, sf_dir):
    """BI measures of the production fact at brand and year level."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("decimal(12,2)").alias("unit_cost"))
    d = daily(spark, sf_dir).join(p, F.col("l_partkey") == F.col("p_partkey")).withColumns({"year": F.to_date(F.date_trunc("year", "production_date")), "_gold_updated_ts": F.col("production_date")})
    out = views.evaluate(d, [*_M, "Data As Of"], ["year", "p_brand"])
    return measured(out, ["year", "p_brand", F.col("Data As Of").alias("data_as_of")], list(_M))


@query(f"""{SQL_OEE}, a AS (SELECT DATE '1998-01-01' + CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS production_date, user_id AS l_suppkey, count(*) FILTER (WHERE value > 100) AS alarms FROM events GROUP BY 1, 2),
s AS (SELECT date_trunc('month', production_date)::DATE AS month, sum(planned_minutes) AS planned, sum(downtime_minutes) AS down, sum(available_minutes) AS avail, sum(ideal_units) AS ideal, sum(units_produced) AS made, sum(units_good) AS good, sum(coalesce(alarms, 0)) AS alarms FROM oee LEFT JOIN a USING (production_date, l_suppkey) GROUP BY 1)
SELECT month, {listed(_MACHINE)} FROM s""")
def measures_machine(spark, sf_dir):
    """BI measures of the machine fact by month, with sensor alarms."""
    f = floor(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    day = F.date_add(F.lit("1998-01-01").cast("date"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    minutes = e.select(day.alias("event_date"), F.col("user_id").cast("string").alias("machine_id"), F.col("ts").alias("window_start"), F.lit("vibration").alias("sensor_type"), F.col("value").alias("avg_value"), F.col("value").alias("max_value"), (F.col("value") > 100).alias("is_anomaly"))
    days = facts.machine_daily(production(f), f.work_orders, f.machines, f.plants, minutes).withColumn("month", F.to_date(F.date_trunc("month", "production_date")))
    return measured(views.evaluate(days, list(_MACHINE), ["month"]), ["month"], list(_MACHINE))


@query(f"""
WITH o AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS machine_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'BREAKDOWN' ELSE 'PREVENTIVE' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'OPEN' END AS status, 30 + o_orderkey % 90 AS repair FROM orders),
m AS (SELECT machine_id, count(*) FILTER (WHERE kind = 'BREAKDOWN' AND status = 'COMPLETED') AS broke, sum(repair) FILTER (WHERE kind = 'BREAKDOWN' AND status = 'COMPLETED') AS repair, count(*) FILTER (WHERE status <> 'COMPLETED') AS open FROM o GROUP BY 1),
r AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS machine_id, sum(CAST(l_quantity AS DOUBLE) * 3) / 60 AS hours FROM lineitem GROUP BY 1)
SELECT machine_id, {listed({"Breakdowns": "broke", "MTTR (min)": "repair / nullif(broke, 0)", "Open Work Orders": "open", "Run Hours": "hours", "MTBF (hrs)": "hours / nullif(broke, 0)"})} FROM r JOIN m USING (machine_id)""")
def measures_maintenance(spark, sf_dir):
    """BI measures of the maintenance fact by machine, with the one that needs two facts."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    orders = o.select(
        F.col("o_orderkey").cast("string").alias("work_order_id"), F.pmod("o_custkey", F.lit(50)).cast("string").alias("machine_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "BREAKDOWN").otherwise("PREVENTIVE").alias("work_type"), F.lit("P1").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("OPEN").alias("status"), at.alias("reported_at"), at.alias("started_at"), F.timestamp_seconds(F.unix_seconds(at) + (F.col("o_orderkey") % 90 + 30) * 60).alias("completed_at"),
        F.lit(0).alias("downtime_minutes"), F.lit("t").alias("technician"), F.lit(False).alias("_is_deleted"),
    )
    machines = history.empty_scd2(orders.withColumn("a", F.lit("")), ["machine_id"], ["a"], "machine_sk")
    events = facts.maintenance_event(orders, machines)
    ran = daily(spark, sf_dir).withColumn("machine_id", F.pmod("l_suppkey", F.lit(50)).cast("string"))
    both = views.mtbf_hours(ran, events, ["machine_id"]).drop("Breakdowns").join(views.evaluate(events, ["Breakdowns", "MTTR (min)", "Open Work Orders"], ["machine_id"]), "machine_id")
    return measured(both, ["machine_id"], ["Breakdowns", "MTTR (min)", "Open Work Orders", "Run Hours", "MTBF (hrs)"])


SQL_DELIVERIES = """
WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS delivery_id, 'C' || o_custkey AS supplier_id, 'Name ' || o_orderpriority AS supplier_name, 'N' || (o_custkey % 30) AS plant_id, CAST(o_orderdate AS DATE) AS delivery_date, 100 + o_orderkey % 7 AS delivered_qty, o_orderkey % 5 AS rejected_qty, o_orderstatus = 'P' AS gone, strftime(o_orderdate, '%Y%m%d') AS seq FROM orders),
s AS (SELECT supplier_id, arg_max(supplier_name, (seq, delivery_id)) AS supplier_name FROM d WHERE NOT gone GROUP BY 1)
"""


def delivered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as delivery lines, and the supplier dimension that they give."""
    o = table(spark, sf_dir, "orders")
    d = o.select(
        F.col("o_orderkey").cast("string").alias("delivery_id"), F.concat(F.lit("C"), "o_custkey").alias("supplier_id"), F.concat(F.lit("Name "), "o_orderpriority").alias("supplier_name"), F.lit("m").alias("material_code"),
        F.concat(F.lit("N"), F.pmod("o_custkey", F.lit(30))).alias("plant_id"), F.to_date("o_orderdate").alias("delivery_date"), (F.col("o_orderkey") % 7 + 100).cast("int").alias("delivered_qty"), (F.col("o_orderkey") % 5).cast("int").alias("rejected_qty"), F.lit("l").alias("lot_number"),
        (F.col("o_orderstatus") == "P").alias("_is_deleted"), F.date_format("o_orderdate", "yyyyMMdd").alias("_sequence"),
    )
    empty = d.limit(0).select(F.lit(0).cast("long").alias("supplier_sk"), "supplier_id", "supplier_name", F.lit("").alias("attr_hash"))
    return d, facts.dim_supplier(empty, d)


@query(f"{SQL_DELIVERIES} SELECT supplier_id, supplier_name FROM s")
def dim_supplier(spark, sf_dir):
    """Type 1 suppliers with the name of their latest delivery that is not deleted."""
    return delivered(spark, sf_dir)[1].select("supplier_id", "supplier_name")


@query(f"{SQL_DELIVERIES} SELECT delivery_id, CAST(strftime(delivery_date, '%Y%m%d') AS INT) AS date_key, s.supplier_name, coalesce(n_name, 'miss') AS plant, delivered_qty, rejected_qty, delivered_qty - rejected_qty AS accepted_qty FROM d JOIN s USING (supplier_id) LEFT JOIN nation ON plant_id = 'N' || n_nationkey WHERE NOT gone")
def fact_supplier(spark, sf_dir):
    """The delivery fact with its suppliers and plants; an unknown plant has key -1."""
    d, suppliers = delivered(spark, sf_dir)
    plants = floor(spark, sf_dir).plants
    out = facts.supplier_delivery(d, suppliers, plants).join(suppliers.select("supplier_sk", "supplier_name"), "supplier_sk").join(plants.select("plant_sk", "plant_name"), "plant_sk", "left")
    plant = F.when(F.col("plant_sk") == -1, "miss").otherwise(F.col("plant_name"))
    return out.select("delivery_id", "date_key", "supplier_name", plant.alias("plant"), F.col("delivered_qty").cast("long").alias("delivered_qty"), F.col("rejected_qty").cast("long").alias("rejected_qty"), F.col("accepted_qty").cast("long").alias("accepted_qty"))


@query(f"{SQL_DELIVERIES} SELECT supplier_id, {sql_round('sum(rejected_qty) / nullif(sum(delivered_qty), 0)')} AS reject_rate FROM d WHERE NOT gone GROUP BY 1")
def measures_delivery(spark, sf_dir):
    """The BI measure of the delivery fact by supplier."""
    d, suppliers = delivered(spark, sf_dir)
    out = facts.supplier_delivery(d, suppliers, floor(spark, sf_dir).plants).join(suppliers.select("supplier_sk", "supplier_id"), "supplier_sk")
    return views.evaluate(out, ["Supplier Reject Rate %"], ["supplier_id"]).select("supplier_id", plain(F.col("Supplier Reject Rate %")).alias("reject_rate"))


@query(f"""
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS machine_id, s_nationkey AS n, s_acctbal < 0 AS gone FROM supplier)
SELECT machine_id, 'N' || n AS plant_id, false AS deleted, DATE '1900-01-01' AS effective_from, CASE WHEN gone OR n % 3 = 0 THEN DATE '1998-01-01' ELSE DATE '9999-12-31' END AS effective_to FROM s
UNION ALL SELECT machine_id, CASE WHEN n % 3 = 0 THEN 'X' ELSE 'N' || n END, gone, DATE '1998-01-01', DATE '9999-12-31' FROM s WHERE gone OR n % 3 = 0
""")
def dim_machine(spark, sf_dir):
    """Type 2 machines over two snapshots: some move plant, some are deleted at the source and flagged."""
    f = floor(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("machine_id"), F.col("s_nationkey").alias("n"), (F.col("s_acctbal") < 0).alias("gone"))
    second = f.machines.drop("machine_sk", "attr_hash", "effective_from", "effective_to", "is_current", "is_source_deleted").join(s, "machine_id")
    second = second.withColumns({"plant_id": F.when(F.col("n") % 3 == 0, "X").otherwise(F.col("plant_id")), "_is_deleted": F.col("gone"), "source_modified_at": F.lit("1998-01-01").cast("timestamp")})
    out = facts.dim_machine(f.machines, second)
    return out.select("machine_id", "plant_id", F.col("is_source_deleted").alias("deleted"), F.to_date("effective_from").alias("effective_from"), F.to_date("effective_to").alias("effective_to"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_size + 10 AS cycle, DATE '1900-01-01' AS effective_from, p_type <> 'ECONOMY' AS is_current FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_size + 25, DATE '1998-01-01', true FROM part WHERE p_type = 'ECONOMY'
""")
def dim_product(spark, sf_dir):
    """Type 2 products: a changed cycle time opens a version, an unchanged product keeps its own."""
    return floor(spark, sf_dir).products.select("product_id", F.col("std_cycle_time_sec").alias("cycle"), F.to_date("effective_from").alias("effective_from"), "is_current")


@query("SELECT 'N' || n_nationkey AS plant_id, n_name AS plant_name FROM nation")
def dim_plant(spark, sf_dir):
    """Type 1 plants."""
    return floor(spark, sf_dir).plants.select("plant_id", "plant_name")


@query(f"{SQL_FACT} SELECT production_date, l_suppkey, l_partkey, production_runs, units_produced, units_scrapped, inspections, failed_inspections FROM fact")
def gold_build(spark, sf_dir):
    """All facts built twice from silver tables: everything, then the days that later runs and
    inspections touch; each step is reconciled before the watermarks move."""
    from quernflow.plans import gold

    root, f = workspace(spark), floor(spark, sf_dir)
    silver = {n: VersionedTable(spark, f"{root}/silver/{n}", (k,)) for n, k in (("mes_production_log", "production_log_id"), ("mes_quality_inspection", "inspection_id"), ("cmms_work_order", "work_order_id"))}
    builder = gold.Gold(spark, silver, {n: VersionedTable(spark, f"{root}/gold/{n}") for n in gold.PUBLISHED}, control.Watermarks(VersionedTable(spark, f"{root}/marks")))
    for name, rows in (("dim_machine", f.machines), ("dim_product", f.products), ("dim_plant", f.plants)):
        builder.gold[name].commit(rows, "LOAD")
    late = lambda c: F.col(c) >= F.lit("2001-06-01").cast("timestamp")
    for second in (False, True):
        for name, rows, at in (("mes_production_log", f.runs, "start_ts"), ("mes_quality_inspection", f.inspections, "inspection_ts"), ("cmms_work_order", f.work_orders, "reported_at")):
            silver[name].upsert(rows.where(late(at) if second else ~late(at)))
        builder.build()
    out = builder.gold["fact_production_daily"].read()
    return out.select("production_date", F.col("machine_id").cast("long").alias("l_suppkey"), F.col("product_id").cast("long").alias("l_partkey"), "production_runs", "units_produced", "units_scrapped", "inspections", "failed_inspections")


@query("""
SELECT n_nationkey, n_name, user_email FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('A@X', 'ASIA'), ('B@X', '*'), ('C@X', 'none')) u(user_email, region_name) WHERE region_name IN (r_name, '*')
""")
def row_policy(spark, sf_dir):
    """What each user sees: by entitlement, all by the star, nothing without."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "plant_id")
    rights = spark.createDataFrame([("A@X", "ASIA"), ("B@X", "*"), ("C@X", "none")], "user_email string, plant_id string")
    seen = [access.entitled(rows, rights, u).select("n_nationkey", "n_name", F.lit(u).alias("user_email")) for u in ("A@X", "B@X", "C@X", "D@X")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


# ---------------------------------------------------------------- telemetry and sources

LIMITS = {"view": (0.0, 20.0), "click": (0.05, 50.0), "error": (0.0, 5.0)}
_BAD = " ".join(f"WHEN event_type = '{k}' THEN min(value) < {lo} OR max(value) > {hi}" for k, (lo, hi) in LIMITS.items())
SQL_MINUTES = f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, CAST(user_id AS VARCHAR) AS machine_id, event_type AS sensor_type, count(*) AS reading_count, {sql_round('avg(value)')} AS avg_value, min(value) AS min_value, max(value) AS max_value,
       CASE {_BAD} ELSE false END AS is_anomaly FROM events GROUP BY 1, 2, 3, event_type
"""


def events_as_readings(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("user_id").cast("string").alias("machine_id"), F.col("event_id").cast("string").alias("device_id"), F.col("event_type").alias("sensor_type"), F.col("value").alias("reading_value"), F.col("ts").cast("timestamp").alias("event_ts")
    )


def bodies(df: DataFrame) -> DataFrame:
    """Events as raw messages: padded and upper-case codes, time as text."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    message = F.struct(
        F.concat(F.lit("d"), "event_id").alias("device_id"), F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("machine_id"), F.upper("event_type").alias("sensor_type"), F.col("value").alias("reading_value"), F.lit("u").alias("unit"), at.alias("event_ts")
    )
    text = F.to_json(message)
    broken = F.when(F.col("event_id") % 11 == 0, F.left(text, F.lit(12))).when(F.col("event_id") % 13 == 0, F.replace(text, at, F.lit("soon"))).otherwise(text)
    now = F.lit("2024-02-01").cast("timestamp")
    return df.select(
        text.alias("body"), broken.alias("broken"), F.col("user_id").cast("string").alias("partition_key"), F.lit(0).alias("partition_id"), F.col("event_id").alias("stream_offset"), now.alias("enqueued_ts"), now.alias("_ingest_ts"), F.to_date(now).alias("_ingest_date")
    )


def _minutes(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "machine_id", "sensor_type", "reading_count", plain(F.col("avg_value")).alias("avg_value"), "min_value", "max_value", "is_anomaly")


@query(SQL_MINUTES)
def window_agg(spark, sf_dir):
    """Tumbling-window statistics with the alarm flag, in batch."""
    return _minutes(telemetry.minute_aggregates(events_as_readings(table(spark, sf_dir, "events")), "1 hour", LIMITS))


@query(f"""WITH m AS ({SQL_MINUTES.replace("'hour'", "'minute'")}), l AS (SELECT max(ts) - INTERVAL 10 MINUTES AS cut FROM events)
SELECT m.* FROM m, l WHERE strptime(window_start, '%Y-%m-%d %H:%M') + INTERVAL 1 MINUTE <= cut""")
def stream_minute_agg(spark, sf_dir):
    """The same as a stream of minutes over a feed in which every event comes twice: watermark,
    bounded dedup, append; windows still open at the watermark are withheld."""
    place = workspace(spark)
    source = bodies(table(spark, sf_dir, "events")).drop("broken")
    source.unionByName(source).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{place}/in")
    out = telemetry.minute_aggregates(telemetry.readings(telemetry.parse(stream)), "1 minute", LIMITS)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _minutes(spark.read.schema(out.schema).parquet(f"{place}/out"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) END AS machine_id, CASE WHEN event_id % 11 <> 0 THEN 'D' || event_id END AS device_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS sensor_type, CASE WHEN event_id % 11 <> 0 THEN value END AS reading_value,
       CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN CAST(ts AS DATE) END AS event_date, event_id % 11 <> 0 AND event_id % 13 <> 0 AS valid, CASE WHEN event_id % 11 = 0 THEN left('{"device_id":"d' || event_id, 12) END AS broken_body FROM events
""")
def json_parse(spark, sf_dir):
    """Message bodies parsed by the declared fields; what does not parse is marked and keeps its text."""
    raw = bodies(table(spark, sf_dir, "events"))
    parsed = telemetry.parse(raw.withColumn("body", F.col("broken")))
    cut = F.when(F.col("machine_id").isNull(), F.col("body"))
    return parsed.select(F.col("stream_offset").alias("event_id"), "machine_id", "device_id", "sensor_type", "reading_value", "event_date", F.col("_valid").alias("valid"), cut.alias("broken_body"))


@query("SELECT conv_id, turn, role, CAST(length(text) AS INT) AS n_chars FROM conversations")
def api_pages(spark, sf_dir):
    """Rows served as JSON pages and flattened again."""
    place = workspace(spark)
    c = table(spark, sf_dir, "conversations")
    pages = c.groupBy(F.floor(F.col("conv_id") / 25).alias("page")).agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("data"))
    body = F.to_json(F.struct(F.struct(F.col("page").cast("int").alias("page"), F.size("data").alias("page_size"), F.lit(0).alias("total_count")).alias("meta"), "data"))
    pages.select("page", body.alias("value")).write.partitionBy("page").text(f"{place}/pages")  # a file a page
    rows = extract.explode_pages(spark, f"{place}/pages/*", "conv_id: bigint, turn: bigint, role: string, text: string")
    return rows.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, 'good' AS part FROM supplier UNION ALL SELECT 'b' || n_nationkey, 'b' || n_nationkey || ',x,1,too,many', 'reject' FROM nation")
def csv_landing(spark, sf_dir):
    """CSV drops with broken lines: good rows, and a reject log with the lines' text."""
    place = workspace(spark)
    s = table(spark, sf_dir, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string")).alias("value"))
    bad = table(spark, sf_dir, "nation").select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string"), F.lit(",x,1,too,many")).alias("value"))
    head = spark.range(1).select(F.lit("s_suppkey,s_name,s_nationkey").alias("value"))
    for name, rows in (("good", s), ("bad", bad)):
        # one file each: a supplier file has its header in front
        head.unionByName(rows).coalesce(1).write.text(f"{place}/{name}")
    drop = landing.read_csv_drop(spark, [f"{place}/good", f"{place}/bad"], ["s_suppkey", "s_name", "s_nationkey"], pattern="part-*")
    good, rejected = landing.split_rejects(drop)
    return good.select("s_suppkey", "s_name", F.lit("good").alias("part")).unionByName(rejected.select(F.col("first_field").alias("s_suppkey"), F.col("rejected_line").alias("s_name"), F.lit("reject").alias("part")))


ORDER_FEED = Entity(
    "order_feed", "MES", CDC, ("o_orderkey",), ("cdc_start_lsn", "cdc_seqval"),
    (Attribute("o_orderkey", "o_orderkey", "bigint"), Attribute("status", "status", "string", ("trim", "upper", "empty_to_null")), Attribute("price", "price", "decimal(12,2)"), Attribute("ordered", "ordered", "date")),
    {"status": "UNKNOWN"}, (Rule("key_not_null", "o_orderkey IS NOT NULL"), Rule("price_positive", "price > 0")), "cdc_operation = 1",
)


def land_orders(spark, sf_dir, root: str, day: str) -> None:
    """On day one all orders as inserts, low-priority prices broken; on day two, twice over, urgent
    orders are deleted and the broken prices repaired."""
    o = table(spark, sf_dir, "orders")
    price, second = money("o_totalprice").cast("string"), day > "2024-01-01"
    operation = F.when(F.col("o_orderpriority") == "1-URGENT", "1").otherwise("4") if second else F.lit("2")
    rows = o.where("o_orderpriority IN ('1-URGENT', '5-LOW')") if second else o
    rows = rows.select(
        F.lit("0x0000000002" if second else "0x0000000001").alias("cdc_start_lsn"), F.lit("0x01").alias("cdc_seqval"), operation.alias("cdc_operation"), F.lit("").alias("cdc_update_mask"), F.lit(f"{day} 00:00:00").alias("cdc_commit_ts"),
        F.col("o_orderkey").cast("string").alias("o_orderkey"), (F.lit("") if second else F.concat(F.lit(" "), F.lower("o_orderstatus"))).alias("status"),
        (price if second else F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(price)).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"),
    )
    rows = rows.unionByName(rows) if second else rows
    rows.write.parquet(landing.raw_path(root, ORDER_FEED, day, landing.run_id_of("order_feed", day, 2 if second else 1)))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'UNKNOWN' ELSE o_orderstatus END AS status, o_orderpriority = '1-URGENT' AS is_deleted, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'order_feed_20240102_02' ELSE 'order_feed_20240101_01' END AS run_id FROM orders
""")
def medallion_stream(spark, sf_dir):
    """Landing to bronze to silver on two days: incremental ingest, lineage, cleansing, quarantine,
    dedup, sequence-guarded merge and reconciliation in each micro-batch."""
    root = workspace(spark)
    silver = VersionedTable(spark, f"{root}/silver", ORDER_FEED.keys)
    processor = SilverProcessor(spark, ORDER_FEED, silver, f"{root}/quarantine")
    for day in ("2024-01-01", "2024-01-02"):
        land_orders(spark, sf_dir, root, day)
        landing.ingest_to_bronze(spark, landing.raw_folder(root, ORDER_FEED), f"{root}/bronze", f"{root}/_bronze", ORDER_FEED)
        processor.run(f"{root}/bronze", f"{root}/_silver")
    return silver.read().select("o_orderkey", "status", F.col("_is_deleted").alias("is_deleted"), F.col("_ingestion_run_id").alias("run_id"))


@query("""
WITH r AS (SELECT 'D' || o_orderkey AS delivery_id, 'Supplier' AS supplier_name, 'C' || o_custkey AS supplier_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS INT) END AS delivered_qty,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 400 WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 3 END AS rejected_qty, CAST(o_orderdate AS DATE) AS delivery_date FROM orders)
SELECT *, delivered_qty - rejected_qty AS accepted_qty FROM r WHERE delivered_qty > 0 AND rejected_qty BETWEEN 0 AND delivered_qty
""")
def supplier_cleansing(spark, sf_dir):
    """Strict cleansing: bad lines are dropped, repeated keys collapse, the accepted quantity is added."""
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.concat(F.lit(" d"), F.col("o_orderkey").cast("string")).alias("delivery_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("supplier_id"), F.lit("  supplier").alias("supplier_name"), F.lit("m").alias("material_code"), F.lit("p").alias("plant_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("delivery_date"), F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string")).alias("delivered_qty"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "400").when(F.col("o_orderpriority") == "5-LOW", "").otherwise("3").alias("rejected_qty"), F.lit("l").alias("lot_number"),
    )
    out = cleanse.supplier_lines(raw.unionByName(raw))
    return out.select("delivery_id", "supplier_name", "supplier_id", "delivered_qty", "rejected_qty", "delivery_date", "accepted_qty")


@query(f"""{SQL_HISTORY} SELECT l_orderkey * 10 + l_linenumber AS inspection_id, l_partkey, CAST(strftime(l_shipdate, '%Y%m%d') AS INT) AS date_key, coalesce(nullif(l_returnflag, 'N'), 'NONE') AS defect_code, coalesce(d.status, 'miss') AS status, CAST(l_quantity AS INT) AS sample_size
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN dim d ON d.o_custkey = o.o_custkey AND CAST(l.l_shipdate AS DATE) >= d.effective_from AND CAST(l.l_shipdate AS DATE) < d.effective_to WHERE l_linestatus <> 'O'""")
def fact_inspection(spark, sf_dir):
    """The inspection fact: live rows, versions in force, a default defect code."""
    h = customer_history(spark, sf_dir)
    names = h.select(F.col("customer_sk").alias("machine_sk"), "status")
    machines = h.select("customer_sk", F.col("o_custkey").cast("string").alias("machine_id"), "effective_from", "effective_to").withColumnRenamed("customer_sk", "machine_sk")
    products = machines.select(F.col("machine_sk").alias("product_sk"), F.lit("none").alias("product_id"), "effective_from", "effective_to")
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    rows = l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inspection_id"), F.col("l_partkey").alias("production_log_id"), F.col("o_custkey").cast("string").alias("machine_id"), F.lit("part").alias("product_id"), F.to_date("l_shipdate").cast("timestamp").alias("inspection_ts"),
        F.col("l_quantity").cast("int").alias("sample_size"), F.lit(0).alias("defect_count"), F.expr("nullif(l_returnflag, 'N')").alias("defect_code"), F.lit("PASS").alias("inspection_result"), F.lit("i").alias("inspector_id"), (F.col("l_linestatus") == "O").alias("_is_deleted"),
    )
    out = facts.quality_inspection(rows, machines, products).join(names, "machine_sk", "left")
    return out.select("inspection_id", F.col("production_log_id").alias("l_partkey"), "date_key", "defect_code", F.coalesce("status", F.lit("miss")).alias("status"), "sample_size")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS work_order_id, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS reported_date_key, CASE WHEN o_orderstatus = 'F' THEN CAST(strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') AS INT) END AS completed_date_key,
       CAST(o_custkey % 50 AS INT) AS response_minutes, CASE WHEN o_orderstatus = 'F' THEN 1440 END AS repair_minutes, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'OPEN' END AS status FROM orders
""")
def fact_maintenance(spark, sf_dir):
    """The accumulating snapshot: response and repair times as far as they are known."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    done = F.col("o_orderstatus") == "F"
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("work_order_id"), F.lit("m").alias("machine_id"), F.lit("BREAKDOWN").alias("work_type"), F.lit("P1").alias("priority"), F.when(done, "COMPLETED").otherwise("OPEN").alias("status"), F.col("at").alias("reported_at"),
        F.timestamp_seconds(F.unix_timestamp("at") + F.pmod("o_custkey", F.lit(50)) * 60).alias("started_at"), F.when(done, F.col("at") + F.expr("INTERVAL 1 DAY")).alias("completed_at"), F.lit(0).alias("downtime_minutes"), F.lit("t").alias("technician"), F.lit(False).alias("_is_deleted"),
    )
    machines = history.empty_scd2(rows.withColumn("a", F.lit("")), ["machine_id"], ["a"], "machine_sk")
    out = facts.maintenance_event(rows, machines)
    return out.select("work_order_id", "reported_date_key", "completed_date_key", "response_minutes", "repair_minutes", "status")


@query("""
SELECT n_nationkey AS k, upper(n_name) AS up, lower(n_name) AS low, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS proper, trim('  ' || n_name || ' ') AS trimmed, concat_ws('|', n_name, CAST(n_regionkey AS VARCHAR)) AS joined, CAST(length(n_name) AS INT) AS len,
       sha256(n_name) AS digest, regexp_extract('run_id=' || n_name || '/x', 'run_id=([^/]+)', 1) AS part, nullif(n_regionkey, 1) AS no_one, greatest(n_regionkey, 2) AS up_to, least(n_regionkey, NULL, 2) AS at_most, coalesce(nullif(n_regionkey, 1), -1) AS filled, CASE WHEN n_regionkey > 2 THEN 'high' ELSE 'low' END AS band FROM nation
""")
def scalar_functions(spark, sf_dir):
    """The string, hash and conditional functions the engine uses."""
    n, name, key = table(spark, sf_dir, "nation"), F.col("n_name"), F.col("n_regionkey")
    proper = F.initcap(F.regexp_replace(name, "_", "~"))
    return n.select(
        F.col("n_nationkey").alias("k"), F.upper(name).alias("up"), F.lower(name).alias("low"), F.regexp_replace(proper, "~", "_").alias("proper"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.concat_ws("|", name, key.cast("string")).alias("joined"), F.length(name).alias("len"),
        F.sha2(name, 256).alias("digest"), F.regexp_extract(F.concat(F.lit("run_id="), name, F.lit("/x")), landing.RUN_ID, 1).alias("part"), F.nullif(key, F.lit(1)).alias("no_one"), F.greatest(key, F.lit(2)).alias("up_to"), F.least(key, F.lit(None).cast("int"), F.lit(2)).alias("at_most"),
        F.coalesce(F.nullif(key, F.lit(1)), F.lit(-1)).alias("filled"), F.when(key > 2, "high").otherwise("low").alias("band"),
    )


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow, date_trunc('month', o_orderdate)::DATE AS first_day,
       strftime(o_orderdate, '%Y%m%d') AS text, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN '2024-02-30' ELSE '2024-02-28' END AS DATE) AS tried, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders
""")
def date_functions(spark, sf_dir):
    """The date functions the engine uses; what is no date becomes NULL."""
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", d.alias("d"), F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.weekofyear(d).alias("w"), F.dayofweek(d).alias("dow"), F.to_date(F.date_trunc("month", d)).alias("first_day"), F.date_format(d, "yyyyMMdd").alias("text"),
        F.when(F.col("o_orderstatus") == "F", "2024-02-30").otherwise("2024-02-28").try_cast("date").alias("tried"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"),
    )


@query(f"""{SQL_VERSIONS} SELECT o_orderkey, order_date, {sql_round('price', 2)} AS price FROM a""")
def publish_serving(spark, sf_dir):
    """A serving copy brought up to date from a versioned table's recorded changes, reconciled, then read by SQL."""
    from quernflow.plans import gold

    root = workspace(spark)
    source, target = VersionedTable(spark, f"{root}/gold", ("o_orderkey",)), VersionedTable(spark, f"{root}/serving")
    marks = control.Watermarks(VersionedTable(spark, f"{root}/marks"))
    for snapshot in order_versions(spark, sf_dir):
        source.commit(snapshot.withColumn("price", F.col("price").cast("decimal(18,2)")), "MERGE", record_changes=True)
        reconcile.assert_all_passed([gold.publish_table(source, target, "fact_orders", marks)])
    return gold.serving_sql(spark, {"serving_orders": target}, "SELECT o_orderkey, order_date, CAST(price AS DOUBLE) AS price FROM serving_orders")


@query("""
WITH r AS (SELECT event_type AS check_type, user_id AS entity, arg_max(value < 100, (ts, event_id)) AS passed FROM events GROUP BY 1, 2)
SELECT CASE WHEN event_type = 'view' THEN 'MANIFEST' WHEN event_type = 'click' THEN 'SILVER' WHEN event_type = 'error' THEN 'GOLD' ELSE 'SERVING' END AS check_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS position, entity, passed
FROM (SELECT check_type AS event_type, entity, passed FROM r WHERE check_type IN ('view', 'click', 'error', 'signup'))
""")
def reconciliation_report(spark, sf_dir):
    """The last result of each check, open failures first, in the order data flows."""
    names = {"view": "MANIFEST", "click": "SILVER", "error": "GOLD", "signup": "SERVING"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    e = table(spark, sf_dir, "events").where("event_type <> 'purchase'")
    rows = e.select(kind.alias("check_type"), F.col("user_id").alias("entity"), F.lit("r").alias("run_id"), (F.col("value") < 100).alias("passed"), F.struct("ts", "event_id").alias("checked_at"))
    return reconcile.report(rows).select("check_type", "position", "entity", "passed")


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(greatest(1, ceil(count(*) * 100 / 65536.0)) AS INT) AS files FROM orders GROUP BY 1")
def output_files(spark, sf_dir):
    """Output sizing per status."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).collect()
    return spark.createDataFrame([(r["status"], r["n"], files_for(r["n"] * 100, 1 << 16)) for r in counts], "status string, n long, files int")

