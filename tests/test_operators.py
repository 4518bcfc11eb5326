"""Operators on small rows: the decisions that SQL checks do not reach."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernflow import registry
from quernflow.functions.columns import chain, in_dates, sequence, typed
from quernflow.operators import access, asof, cleanse, dedup, feed, history, quality, reconcile, skew, upsert
from quernflow.plans import views
from quernflow.registry import Attribute, Entity, Rule

ROWS = "k long, v string, _sequence string, _is_deleted boolean"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


class TestCleanse:
    def test_steps_run_from_left_to_right(self, spark):
        df = spark.createDataFrame([("  ab ",), ("   ",), ("\t",)], "s string")
        got = [r[0] for r in df.select(chain(F.col("s"), ["trim", "empty_to_null", "upper"])).collect()]
        assert got == ["AB", None, "\t"]  # trim takes spaces only

    def test_what_cannot_be_cast_is_null(self, spark):
        df = spark.createDataFrame([("x", "2024-13-01"), ("7", "2024-01-02")], "n string, d string")
        assert [tuple(r) for r in df.select(typed(F.col("n"), "int"), typed(F.col("d"), "date")).collect()] == [(None, None), (7, date(2024, 1, 2))]

    def test_defaults_come_before_rules(self, spark):
        e = registry.ENTITIES["mes_production_log"]
        raw = spark.createDataFrame([("1", "M1", "P1", "2024-01-01 06:00:00", "5")], "production_log_id string, machine_id string, product_id string, start_ts string, units_produced string")
        got = quality.check(cleanse.standardise(raw, e), e.rules).select("shift_code", "units_scrapped", "_dq_errors", "_dq_warnings").first()
        assert got["shift_code"] == "UNKNOWN" and got["units_scrapped"] == 0 and got["_dq_errors"] == [] and got["_dq_warnings"] == []

    def test_null_start_is_an_error(self, spark):
        e = registry.ENTITIES["mes_production_log"]
        raw = spark.createDataFrame([("1", "M1", "P1", None, "5")], "production_log_id string, machine_id string, product_id string, start_ts string, units_produced string")
        assert quality.check(cleanse.standardise(raw, e), e.rules).first()["_dq_errors"] == ["start_not_null"]

    def test_sequence_keeps_the_place_of_null(self, spark):
        df = spark.createDataFrame([("0x02", None), ("0x01", "0x09")], "a string, b string").select(sequence([("a", "string"), ("b", "string")]).alias("s"))
        assert sorted(r["s"] for r in df.collect()) == ["0x01|0x09", "0x02|"]

    def test_clock_is_a_parameter(self, spark):
        rule = registry.ENTITIES["supplier_delivery"].rules[-1]
        df = spark.createDataFrame([(date(2024, 1, 2),)], "delivery_date date")
        assert df.select(quality.passes(rule, "2024-01-01")).first()[0] is False and df.select(quality.passes(rule, "2024-01-02")).first()[0] is True

    def test_rule_counts_and_empty_input(self, spark):
        rules = [Rule("a", "k > 1"), Rule("b", "v = 'x'", "WARN")]
        df = spark.createDataFrame([(1, "x"), (2, None), (None, "x")], "k long, v string")
        assert rows_of(quality.rule_counts(quality.check(df, rules), rules), "rule_name", "failed_count") == [("a", 2), ("b", 1)]
        assert rows_of(quality.rule_counts(quality.check(df.limit(0), rules), rules), "rule_name", "failed_count") == [("a", 0), ("b", 0)]
        assert quality.split(df, []).valid.count() == 3


class TestRegistry:
    def test_eight_entities_with_their_rules(self):
        assert len(registry.ENTITIES) == 8
        rules = [r for e in registry.ENTITIES.values() for r in e.rules]
        assert (sum(r.severity == "ERROR" for r in rules), sum(r.severity == "WARN" for r in rules)) == (24, 7)  # one is our own

    @pytest.mark.parametrize("change", [{"pattern": "FTP"}, {"keys": ()}, {"keys": ("nope",)}, {"order": ("nope",)}, {"deleted_when": None}, {"attributes": (Attribute("k", "k", "long", ("shout",)),)}, {"rules": (Rule("r", "true", "FATAL"),)}, {"name": "a; drop"}, {"defaults": {"nope": 1}}])
    def test_bad_entities_are_refused(self, change):
        good = dict(name="e", system="S", pattern=registry.CDC, keys=("k",), order=("cdc_start_lsn",), attributes=(Attribute("k", "k", "long"),), deleted_when="cdc_operation = 1")
        Entity(**good)
        with pytest.raises(ValueError):
            Entity(**(good | change))

    def test_identifiers(self):
        assert registry.identifier("a.b.c") == "a.b.c"
        for bad in ("a b", "a.b.c.d", "1a", "a;b", ""):
            with pytest.raises(ValueError):
                registry.identifier(bad)


class TestUpsert:
    def table(self, spark, rows):
        return spark.createDataFrame(rows, ROWS)

    def test_replay_and_late_arrivals_change_nothing(self, spark):
        target = self.table(spark, [(1, "new", "5", False), (2, "b", "1", False)])
        batch = self.table(spark, [(1, "old", "4", False), (2, "b2", "2", False), (3, "c", "1", False), (4, None, "1", True)])
        once = upsert.upsert(target, batch, ["k"])
        assert rows_of(once, "k", "v") == [(1, "new"), (2, "b2"), (3, "c")]
        assert rows_of(upsert.upsert(once, batch, ["k"]), "k", "v", "_sequence") == rows_of(once, "k", "v", "_sequence")

    def test_delete_modes_and_tombstones(self, spark):
        target = self.table(spark, [(1, "a", "1", False)])
        batch = self.table(spark, [(1, "a", "2", True), (9, None, "2", True)])
        assert rows_of(upsert.upsert(target, batch, ["k"]), "k", "_is_deleted") == [(1, True)]
        assert upsert.upsert(target, batch, ["k"], delete_mode="hard").count() == 0
        held = upsert.upsert(target, batch, ["k"], keep_tombstones=True)
        late = upsert.upsert(held, self.table(spark, [(9, "ghost", "1", False)]), ["k"])
        assert rows_of(late, "k", "_is_deleted") == [(1, True), (9, True)]
        with pytest.raises(ValueError):
            upsert.upsert(target, batch, ["k"], delete_mode="maybe")

    def test_null_keys_match_each_other(self, spark):
        got = upsert.upsert(self.table(spark, [(None, "a", "1", False)]), self.table(spark, [(None, "b", "2", False)]), ["k"])
        assert rows_of(got, "v") == [("b",)]

    @settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(order=st.permutations(range(6)))
    def test_any_order_of_batches_converges(self, spark, order):
        log = [(k, f"v{s}", str(s), s == 5 and k == 1) for s in range(1, 6) for k in (1, 2)][:6] + []
        target = self.table(spark, [(1, "v0", "0", False), (2, "v0", "0", False)])
        for i in order:
            target = upsert.upsert(target, self.table(spark, [log[i]]), ["k"])
        best = {k: max((x for x in log if x[0] == k), key=lambda x: x[2]) for k in (1, 2)}
        assert rows_of(target, "k", "v") == [(k, best[k][1]) for k in (1, 2)]

    def test_replace_dates(self, spark):
        d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
        old = spark.createDataFrame([(d1, 1), (d1, 2), (d2, 3)], "d date, n int")
        new = spark.createDataFrame([(d1, 9), (d2, 8)], "d date, n int")
        assert rows_of(upsert.replace_dates(old, new, "d", [d1]), "n") == [(3,), (9,)]
        assert upsert.replace_dates(old, new, "d", []).count() == 3 and upsert.replace_dates(old, new, "d", None).count() == 2
        assert upsert.delete_matching(old, spark.createDataFrame([(2,)], "n int"), ["n"]).count() == 2


class TestDedup:
    def test_ties_are_settled_the_same_way_whatever_the_order(self, spark):
        rows = [(1, "b", "1", False), (1, "a", "1", False), (1, "c", "0", False)]
        got = {dedup.latest(spark.createDataFrame(list(r), ROWS).repartition(3), ["k"], tie=["v"]).first()["v"] for r in (rows, rows[::-1])}
        assert got == {"b"}

    def test_one_shuffle(self, spark):
        plan = dedup.latest(spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("_sequence")), ["k"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


class TestFeed:
    def test_images_and_moved_days(self, spark):
        make = lambda rows: spark.createDataFrame(rows, "k long, d date, _row_hash string")
        d = [date(2024, 1, i) for i in range(1, 5)]
        feed_ = feed.changes(make([(1, d[0], "a"), (2, d[1], "b"), (3, None, "c")]), make([(1, d[2], "a2"), (2, d[1], "b"), (4, d[3], "e")]), ["k"], version=1)
        assert rows_of(feed_, "k", "_change_type") == [(1, "update_postimage"), (1, "update_preimage"), (3, "delete"), (4, "insert")]
        assert rows_of(feed.affected_dates(feed_, "d"), "day") == [(d[0],), (d[2],), (d[3],)]  # no NULL
        assert feed.union_dates([d[0]], None) is None and feed.union_dates([d[1], None], [d[0]]) == [d[0], d[1]]

    def test_collapse_takes_the_last_commit(self, spark):
        f = spark.createDataFrame([(1, "a", "insert", 1), (1, "a", "update_preimage", 2), (1, "b", "update_postimage", 2), (2, "x", "insert", 1), (2, "x", "delete", 3)], "k long, v string, _change_type string, _commit_version long")
        collapsed = feed.collapse(f, ["k"])
        assert rows_of(collapsed, "k", "_change_type") == [(1, "update_postimage"), (2, "delete")]
        target = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
        assert rows_of(feed.apply_feed(target, collapsed, ["k"]), "k", "v") == [(1, "b"), (3, "y")]


class TestHistory:
    SOURCE = "k string, a string, at timestamp"

    def load(self, spark, target, rows):
        source = spark.createDataFrame(rows, self.SOURCE)
        target = history.empty_scd2(source, ["k"], ["a"], "sk") if target is None else target
        return history.scd2(target, source, ["k"], ["a"], "at", "sk")

    def test_versions_close_and_open(self, spark):
        t = self.load(spark, None, [("x", "1", datetime(2024, 1, 1)), ("y", "1", datetime(2024, 1, 1))])
        t = self.load(spark, t, [("x", "2", datetime(2024, 2, 1)), ("y", "1", datetime(2024, 2, 1)), ("z", "1", datetime(2024, 2, 1))])
        got = rows_of(t, "k", "a", "effective_from", "effective_to", "is_current")
        begin, end = datetime(1900, 1, 1), datetime(9999, 12, 31)
        assert got == [("x", "1", begin, datetime(2024, 2, 1), False), ("x", "2", datetime(2024, 2, 1), end, True), ("y", "1", begin, end, True), ("z", "1", begin, end, True)]
        assert t.groupBy("k").agg(F.count_if("is_current").alias("n")).where("n <> 1").count() == 0
        assert t.select("sk").distinct().count() == t.count()

    def test_a_late_change_does_not_turn_an_interval_round(self, spark):
        t = self.load(spark, None, [("x", "1", datetime(2024, 1, 1))])
        t = self.load(spark, t, [("x", "2", datetime(2024, 3, 1))])
        t = self.load(spark, t, [("x", "3", datetime(2024, 2, 1))])
        assert t.where("effective_from >= effective_to").count() == 0 and rows_of(t.where("is_current"), "a") == [("2",)]

    def test_reload_is_a_no_op(self, spark):
        rows = [("x", None, datetime(2024, 1, 1))]
        t = self.load(spark, None, rows)
        assert self.load(spark, t, rows).count() == 1

    def test_unknown_member_and_misses(self, spark):
        t = history.with_unknown(self.load(spark, None, [("x", "1", datetime(2024, 1, 1))]), "sk")
        assert t.where("sk = -1").count() == 1
        fact = spark.createDataFrame([("x", datetime(2024, 1, 1)), ("q", datetime(2024, 1, 1)), (None, None)], "k string, at timestamp")
        got = asof.version_in_force(fact, t, "k", "at", "k", "sk")
        assert got.where("sk = -1").count() == 2 and got.count() == 3

    def test_half_open_interval(self, spark):
        t = self.load(spark, self.load(spark, None, [("x", "1", datetime(2024, 1, 1))]), [("x", "2", datetime(2024, 2, 1))])
        fact = spark.createDataFrame([("x", datetime(2024, 2, 1)), ("x", datetime(2024, 1, 31, 23, 59))], "k string, at timestamp")
        assert rows_of(asof.version_in_force(fact, t, "k", "at", "k", "sk", ("a",)), "at", "a") == [(datetime(2024, 1, 31, 23, 59), "1"), (datetime(2024, 2, 1), "2")]

    def test_scd1_rewrites_only_changes(self, spark):
        s = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, a string")
        empty = s.limit(0).select(F.lit(0).cast("long").alias("sk"), "k", "a", F.lit("").alias("attr_hash"))
        t = history.scd1(empty, s, "k", ["a"], "sk")
        t2 = history.scd1(t, s.where("k = 'x'").withColumn("a", F.lit("2")), "k", ["a"], "sk")
        assert rows_of(t2, "k", "a") == [("x", "2"), ("y", "1")] and rows_of(t, "k", "sk") == rows_of(t2, "k", "sk")


class TestSkew:
    def test_salted_equals_plain(self, spark):
        hot = spark.createDataFrame([("HOT", i) for i in range(500)] + [("COLD", i) for i in range(10)] + [("NONE", 0), (None, 1)], "k string, n long")
        small = spark.createDataFrame([("HOT", "h"), ("COLD", "c"), ("OTHER", "o")], "k string, name string")
        for how in ("inner", "left"):
            assert rows_of(skew.salted_join(hot, small, ["k"], 8, how).na.fill("~"), "k", "n", "name") == rows_of(hot.join(small, "k", how).na.fill("~"), "k", "n", "name")
        assert skew.salted_join(hot, small, ["k"], 8, "left_anti").count() == 2
        for how in ("right", "full"):
            with pytest.raises(ValueError):
                skew.salted_join(hot, small, ["k"], 8, how)
        report = skew.skew_report(hot, ["k"], 1).first()
        assert report["k"] == "HOT" and report["times_median"] > 40


class TestReconcile:
    def test_counts_amounts_and_gate(self, spark):
        assert reconcile.compare_counts("e", 10, 9, 1).passed and not reconcile.compare_counts("e", 10, 8, 1).passed
        assert reconcile.compare_counts_and_amounts("e", (1, 1000.0), (1, 1000.09), rel_tol=0.0001).passed
        assert not reconcile.compare_counts_and_amounts("e", (1, 1000.0), (1, 1000.2), rel_tol=0.0001).passed
        with pytest.raises(reconcile.ReconciliationError, match="read=5"):
            reconcile.assert_all_passed([reconcile.silver_balance("e", 5, 3, 1, 0)])
        results = lambda *rows: spark.createDataFrame([("COUNT", "e", "r", p, at) for p, at in rows], "check_type string, entity string, run_id string, passed boolean, checked_at int")
        reconcile.gate(results((False, 1), (True, 2)))
        with pytest.raises(reconcile.ReconciliationError):
            reconcile.gate(results((True, 1), (False, 2)))

    def test_missing_or_older(self, spark):
        batch = spark.createDataFrame([(1, "a", "2", False), (2, "b", "1", False), (3, None, "1", True)], ROWS)
        target = spark.createDataFrame([(1, "a", "1", False)], ROWS)
        assert rows_of(reconcile.missing_or_older(batch, target, ["k"]), "k") == [(1,), (2,)]


class TestViews:
    def test_ratios_without_a_divisor_are_null(self, spark):
        m = spark.createDataFrame([(0, 0, 0, 0, 0)], "available_minutes long, planned_minutes long, units_produced long, ideal_units long, units_good long")
        got = views.evaluate(m, ["Availability %", "Performance %", "Quality %", "OEE %"]).first()
        assert all(x is None for x in got)

    def test_two_facts_are_refused(self, spark):
        with pytest.raises(ValueError):
            views.evaluate(spark.range(1), ["Units Produced", "Breakdowns"])

    def test_prior_year_skips_leap_days(self, spark):
        d = spark.createDataFrame([(date(2024, 2, 28), 5), (date(2024, 2, 29), 7), (date(2025, 2, 28), 10)], "production_date date, units_produced long")
        got = {r["production_date"]: r["units_produced_py"] for r in views.prior_year(d, "production_date", "units_produced").collect()}
        assert got[date(2025, 2, 28)] == 5 and len(got) == 3

    def test_rolling_counts_calendar_days(self, spark):
        d = spark.createDataFrame([(date(2024, 1, 1), 1), (date(2024, 1, 7), 2), (date(2024, 1, 8), 4)], "d date, n long")
        assert [r["n_7d"] for r in views.rolling(d, "d", ["n"]).orderBy("d").collect()] == [1, 3, 6]

    def test_entitlement(self, spark):
        rows = spark.createDataFrame([("P1",), ("P2",)], "plant_id string")
        rights = spark.createDataFrame([("A@X", "P1"), ("B@X", "*")], "user_email string, plant_id string")
        assert [access.entitled(rows, rights, u).count() for u in ("a@x", "b@x", "c@x")] == [1, 2, 0] and access.entitled(rows, rights, "c@x", exempt=True).count() == 2

    def test_date_predicate(self, spark):
        d = spark.createDataFrame([(date(2024, 1, 1),), (None,)], "d date")
        assert [d.where(in_dates("d", x)).count() for x in (None, [], [date(2024, 1, 1)])] == [2, 0, 1]
