"""Statistics helpers against Python's math library, and experiment invariants on the real tables."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM
from retentia.functions.stats import chi2_sf_dof1, erfc_nonneg, normal_cdf, two_sided_p
from retentia.operators import experiment as ab
from retentia.plans import frames


def test_erfc_has_relative_accuracy_in_the_tail(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 1.5, 2.0, 3.0, 4.5, 6.0, 10.0, 20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(erfc_nonneg(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.erfc(x), rel=1e-9)


def test_p_values_of_strong_effects_are_not_cut(spark):
    df = spark.createDataFrame([(5.16,), (7.37,), (8.0,)], "z double")
    got = [r[0] for r in df.select(two_sided_p(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in (5.16, 7.37, 8.0)], rel=1e-9)
    assert all(p > 0 for p in got)


def test_normal_and_chi2(spark):
    df = spark.createDataFrame([(1.96,), (-1.0,), (0.0,)], "z double")
    r = df.select(two_sided_p(F.col("z")), normal_cdf(F.col("z")), chi2_sf_dof1(F.col("z") * F.col("z"))).collect()
    assert r[0][0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-12)
    assert r[1][1] == pytest.approx(0.5 * math.erfc(1 / math.sqrt(2)), rel=1e-12)
    assert r[2][0] == pytest.approx(1.0, abs=1e-12)
    assert r[0][2] == pytest.approx(r[0][0], rel=1e-9)  # chi2(1) tail of z^2 = two-sided normal p


@pytest.fixture(scope="module")
def ab_input(spark):
    return ab.prepare_ab_input(frames.scored(spark, MEDIUM))


def test_groups_partition_rows_near_half(ab_input):
    g = ab.assign_groups(ab_input, "t1", 0.5)
    counts = {r[0]: r[1] for r in g.groupBy("t1_group").count().collect()}
    total = ab_input.count()
    assert sum(counts.values()) == total
    assert abs(counts["control"] / total - 0.5) < 0.15
    # stable under repartitioning
    again = ab.assign_groups(ab_input.repartition(3), "t1", 0.5)
    assert sorted(map(tuple, g.select("player_id", "t1_group").collect())) == \
        sorted(map(tuple, again.select("player_id", "t1_group").collect()))


def test_result_counts_the_observed_outcome(spark, ab_input):
    r = ab.run_ab_test(ab_input, "t2", "discount_offer").collect()[0]
    rows = ab.assign_groups(ab_input, "t2").select("t2_group", "churned").collect()
    treated = [x.churned for x in rows if x.t2_group == "treatment"]
    assert r.treatment_size == len(treated) and r.treatment_churn_rate == pytest.approx(sum(treated) / len(treated))
    assert r.control_size + r.treatment_size == len(rows)
    assert r.conclusion in ("SIGNIFICANT", "NOT SIGNIFICANT")
    given = spark.createDataFrame([("control", 1), ("control", 0), ("treatment", 0), ("treatment", 0)], "t3_group string, left int")
    kept = ab.run_ab_test(given, "t3", "discount_offer", outcome="left").collect()[0]  # groups of a test that has run
    assert (kept.control_size, kept.control_churn_rate, kept.treatment_churn_rate) == (2, 0.5, 0.0)


def test_expected_effect_is_a_multiplier(spark):
    df = spark.createDataFrame([("control", 0.4), ("treatment", 0.4)], "t_group string, churn_probability double")
    got = {r.t_group: r.expected_churn_prob for r in ab.expected_effect(df, "t", "discount_offer").collect()}
    assert got == {"control": 0.4, "treatment": pytest.approx(0.34)}


def test_no_effect_has_no_sample_size(spark):
    assert spark.range(1).select(ab.sample_size(F.lit(0.2), 0.0).alias("n")).first().n is None


def test_larger_effect_needs_smaller_sample(spark):
    df = spark.createDataFrame([(0.2,)], "b double")
    small, large = df.select(ab.sample_size(F.col("b"), 0.02), ab.sample_size(F.col("b"), 0.10)).collect()[0]
    assert small > large > 0


def test_missing_group_raises(ab_input):
    with pytest.raises(ValueError):
        ab.expected_effect(ab_input, "nope", "discount_offer")


def test_roi_zero_saved(spark):
    row = spark.createDataFrame([("x", 100, 0.0)], "test_name string, treatment_size long, absolute_lift double")
    r = ab.ab_roi(row, 5.0, 300.0).collect()[0]
    assert r.players_saved == 0.0 and r.cost_per_retained_player == 0.0 and r.roi_percentage == -100.0


def _reference_stats(a, b, c, d):
    """Direct Python: Yates-corrected chi-square p (dof 1) and the pooled two-proportion z-test p."""
    n = a + b + c + d
    r1, r2, k1, k2 = a + b, c + d, a + c, b + d
    stat = 0.0
    for o, e in ((a, r1 * k1 / n), (b, r1 * k2 / n), (c, r2 * k1 / n), (d, r2 * k2 / n)):
        stat += max(abs(o - e) - 0.5, 0.0) ** 2 / e
    p_chi = math.erfc(math.sqrt(stat / 2))
    pc, pt = a / r1, c / r2  # retained shares (a, c = retained counts)
    pool = (a + c) / n
    se = math.sqrt(pool * (1 - pool) * (1 / r1 + 1 / r2))
    z = (pt - pc) / se
    return stat, p_chi, z, math.erfc(abs(z) / math.sqrt(2))


@pytest.mark.parametrize("counts", [(400, 100, 430, 70), (50, 50, 60, 40), (900, 10, 880, 30)])
def test_two_by_two_statistics(spark, counts):
    a, b, c, d = counts  # control retained / churned, treatment retained / churned
    row = spark.createDataFrame([(a + b, b, c + d, d)],
                                "control_n long, control_churned long, treatment_n long, treatment_churned long")
    cols = {**ab.chi_square_columns(), **ab.z_test_columns()}
    r = row.select(*[v.alias(k) for k, v in cols.items()]).collect()[0]
    stat, p_chi, z, p_z = _reference_stats(a, b, c, d)
    assert r.chi2_statistic == pytest.approx(stat, rel=1e-12)
    assert r.chi2_p_value == pytest.approx(p_chi, rel=1e-9) and r.chi2_dof == 1
    assert r.z_score == pytest.approx(z, rel=1e-12)
    assert r.z_p_value == pytest.approx(p_z, rel=1e-9)


def test_one_outcome_has_no_degree_of_freedom(spark):
    row = spark.createDataFrame([(10, 0, 12, 0)],
                                "control_n long, control_churned long, treatment_n long, treatment_churned long")
    r = row.select(*[v.alias(k) for k, v in ab.chi_square_columns().items()]).collect()[0]
    assert (r.chi2_statistic, r.chi2_p_value, r.chi2_dof) == (0.0, 1.0, 0)


@pytest.mark.parametrize("n", [1, 7, 60, 149, 150, 500])
def test_sample_equals_global_ordered_take(spark, n):
    from retentia.functions.hashing import unit_hash
    from retentia.operators.segments import sample_players
    scored = frames.scored(spark, MEDIUM).select("player_id")
    got = [r.player_id for r in sample_players(scored, n, seed=7).collect()]
    want = [r.player_id for r in scored.withColumn("_d", unit_hash("7", F.col("player_id")))
            .orderBy("_d", "player_id").limit(n).collect()]
    assert sorted(got) == sorted(want) and len(got) == min(n, scored.count())
