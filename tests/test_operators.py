import datetime
import hashlib
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyspark.functions import money, text
from tallyspark.operators import assignment, attribution, audit, blocking, calibration, evaluation, exceptions, forecast, linkage, matching, policy, subsets, waterfall
from tallyspark.sources import sinks


def test_assignment_beats_greedy_and_abstains():
    weights = np.array([[9.0, 8.8], [8.9, np.nan]])
    assert attribution.assign_one_to_one(weights, 0.0) == [(0, 1), (1, 0)]
    assert attribution.assign_one_to_one(np.array([[2.0]]), 5.0) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    weights = np.random.default_rng(seed).integers(-5, 20, (n, m)).astype(float)
    found = attribution.assign_one_to_one(weights, 3.0)
    value = sum(weights[a, b] for a, b in found) + 3.0 * (n - len(found))
    best = max(
        sum(weights[r, c] for r, c in zip(rows, columns)) + 3.0 * (n - k)
        for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for columns in itertools.permutations(range(m), k)
    )
    assert value == pytest.approx(best)


def scored_pairs(spark, weights):
    rows = [(f"a{i}", f"b{j}", float(w), "x") for i, own in enumerate(weights) for j, w in enumerate(own)]
    return spark.createDataFrame(rows, "left_id string, right_id string, weight double, gain string")


@pytest.mark.parametrize("n, m, share, seed", [(25, 25, 0.2, 1), (40, 30, 0.1, 2)])
def test_assignment_of_a_table(spark, n, m, share, seed):
    rng = np.random.default_rng(seed)
    weights = rng.normal(4, 4, (n, m)).round(4)
    weights[rng.random((n, m)) > share] = np.nan
    got = assignment.one_to_one(scored_pairs(spark, weights), 1.0).collect()
    assert len({r.left_id for r in got}) == len(got) == len({r.right_id for r in got})
    want = attribution.assign_one_to_one(weights, 1.0)
    assert sum(r.weight - 1.0 for r in got) == pytest.approx(sum(weights[a, b] - 1.0 for a, b in want))
    assert all(r.weight == weights[int(r.left_id[1:]), int(r.right_id[1:])] > 1.0 for r in got)


def test_assignment_by_auction(spark):
    weights = np.array([[7, 6, np.nan, 5], [7, 6, 4, np.nan], [6, 6, 5, 4], [np.nan, 3, 5, 3]])
    edges = scored_pairs(spark, weights).drop("gain").where("NOT isnan(weight)").select("left_id", "right_id", F.col("weight").cast("long").alias("gain"))
    found = {(r.left_id, r.right_id) for r in assignment.auction(edges).collect()}
    assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found)
    assert sum(weights[int(a[1:]), int(b[1:])] for a, b in found) == sum(weights[a, b] for a, b in attribution.assign_one_to_one(weights, 0.0))


def test_assignment_of_awkward_tables(spark):
    none = scored_pairs(spark, np.zeros((0, 0)))
    assert assignment.one_to_one(none).count() == 0
    rows = [("a", "x", 2.0), ("a", "x", 3.0), ("b", "x", None), (None, "x", 9.0), ("b", None, 9.0), ("b", "y", float("nan")), ("b", "y", float("inf")), ("c", "y", 5.0), ("d", "z", 1.0)]
    got = assignment.one_to_one(spark.createDataFrame(rows, "left_id string, right_id string, weight double"), 1.0)
    assert sorted(map(tuple, got.collect())) == [("a", "x", 3.0), ("c", "y", 5.0)]
    tied = assignment.one_to_one(scored_pairs(spark, np.full((4, 4), 2.0)))
    assert tied.count() == 4 and tied.select("right_id").distinct().count() == 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=11), st.integers(0, 200), st.integers(0, 6))
def test_subset_sum_matches_brute_force(items, low, width):
    found = attribution.subset_reaching(np.array(items), low, low + width)
    sizes = [k for k in range(len(items) + 1) for c in itertools.combinations(items, k) if low <= sum(c) <= low + width]
    assert (found is None) == (not sizes)
    if found is not None:
        assert low <= sum(items[k] for k in found) <= low + width and len(found) == max(sizes) and len(set(found)) == len(found)


def test_two_credits_split_exactly():
    nets = np.array([1000, 3000, 5000, 700, 11000])
    done = subsets.split(nets, np.ones(5, np.int64), [4700], 0)
    assert done.status == "found" and (nets * done.parts[0]).sum() == 4700
    assert subsets.split(nets, np.ones(5, np.int64), [4701], 0).status == "none"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 3)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 150), st.integers(0, 4))
def test_all_choices_are_seen(items, low, width):
    values, counts = (np.array(x, np.int64) for x in zip(*items))
    every = {c for c in itertools.product(*(range(n + 1) for n in counts)) if low <= sum(a * b for a, b in zip(c, values)) <= low + width}
    found = [tuple(x.tolist()) for x in subsets.subsets(values, counts, low, low + width)]
    assert len(found) == len(every) and set(found) == every


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=2, max_size=7), st.integers(1, 3), st.integers(0, 10**6), st.integers(0, 1))
def test_splits_are_found_if_there_are_any(items, ways, seed, slack):
    pick = np.random.default_rng(seed)
    needs = [int(x) for x in pick.integers(1, max(2, sum(items) // ways), ways)]
    values, counts = np.unique(items, return_counts=True)
    possible = any(all(abs(sum(x for x, o in zip(items, owner) if o == k) - need) <= slack for k, need in enumerate(needs)) for owner in itertools.product(range(ways + 1), repeat=len(items)))
    done = subsets.split(values, counts, needs, slack)
    assert done.status == ("found" if possible else "none")
    if possible:
        assert all(abs(int((values * p).sum()) - n) <= slack for p, n in zip(done.parts, needs)) and (sum(done.parts) <= counts).all()


def test_round_amounts_among_many_others_and_proofs_of_none(monkeypatch):
    values = np.array([111_111, 222_222, 333_333, 1_000_000])
    for others in (30, 97, 4000):
        assert next(subsets.subsets(values, np.array([1, 1, 1, others]), 666_566, 666_766)).tolist() == [1, 1, 1, 0]
        assert subsets.split(values, np.array([1, 1, 1, others]), [777_777], 100).status == "none"
    odd = np.random.default_rng(3).integers(10**12, 10**13, 60)
    monkeypatch.setattr(subsets, "MOST_SUMS", 1 << 16)
    assert subsets.split(odd, np.ones(60, np.int64), [int(odd.sum()) // 3], 0).status == "limit"


@pytest.mark.parametrize("kind, n, ways", [("round", 12, 3), ("round", 12, 4), ("any", 12, 4), ("any", 30, 3), ("any", 60, 3), ("round", 40, 4), ("any", 300, 3)])
def test_no_solvable_date_is_left(kind, n, ways):
    for seed in range(40 if n <= 12 else 3):
        pick = np.random.default_rng(seed)
        nets = pick.integers(1, 60, n) * 100_000 if kind == "round" else pick.integers(10_000, 5_000_000, n)
        owner = pick.integers(0, ways, n)
        owner[:ways] = np.arange(ways)
        targets = [int(nets[owner == w].sum()) for w in range(ways)]
        values, counts = np.unique(nets, return_counts=True)
        parts, method, status, _ = subsets.attribute(values, counts, targets, 4 * n + 200)
        assert (method, status) == ("all", "found") and (sum(parts) == counts).all()
        assert all(abs(int((values * p).sum()) - t) <= ways * (4 * n + 200) for p, t in zip(parts, targets))


def test_credits_beyond_a_window_take_what_is_left():
    values, counts = np.array([100, 200, 300]), np.array([30, 30, 5])
    targets = [100] * 25 + [200] * 25 + [300] * 5
    got = subsets.attribute_in_windows(values, counts, targets, 0)
    assert [w[0] for w in got] == [0, 20, 40] and all(w[2] in ("some", "all") for w in got)
    assert sum(int((values * p).sum()) for w in got for p in w[1] if p is not None) >= sum(targets) and (sum(p for w in got for p in w[1]) <= counts).all()


def test_several_days_share_windows(spark):
    day = lambda k: datetime.date(2026, 1, 1) + datetime.timedelta(k)
    pick = np.random.default_rng(5)
    rows, credits = [], []
    for k in range(40):
        nets = pick.integers(100_000, 9_000_000, 9).tolist()
        # A credit of each day takes four payments of it and two of the day before.
        rows += [(f"p{k:02d}_{j}", day(k), day(k), day(k + 1), int(x)) for j, x in enumerate(nets)]
        before = [r[4] for r in rows if r[0].startswith(f"p{k - 1:02d}_")][4:6]
        if k != 20:
            credits.append((f"c{k:02d}", day(k), sum(nets[:4]) + sum(before)))
    payments = spark.createDataFrame(rows, "payment_id string, settles_on date, win_low date, win_high date, net_paise long")
    asked = spark.createDataFrame(credits, "credit_id string, landed_on date, amount_paise long")
    taken, seen = attribution.solve_windows(payments, asked)
    found = taken.collect()
    net = {r[0]: r for r in rows}
    assert len({r.payment_id for r in found}) == len(found)
    sums, slack = {}, 10_000
    for r in found:
        p, c = net[r.payment_id], dict((c[0], c[1:]) for c in credits)[r.credit_id]
        assert p[2] <= c[0] <= p[3]
        sums[r.credit_id] = sums.get(r.credit_id, 0) + p[4]
    assert all(abs(sums.get(c, 0) - t) <= slack for c, _, t in credits if c in sums) and len(sums) >= 35
    report = {(r.method, r.status): r for r in attribution.search_report(seen).collect()}
    assert sum(r.asked for r in report.values()) == len(credits) and report["some", "found"].met >= 30


def test_late_credits_win_the_payments_of_the_day_before(spark):
    day = lambda k: datetime.date(2026, 1, k)
    rows = [("a", 5, 1000_00), ("b", 5, 500_00), ("c", 6, 700_00), ("d", 6, 900_00), ("e", 8, 900_00), ("f", 8, 910_00), ("g", 9, 400_00)]
    payments = spark.createDataFrame([(i, day(k), day(k - 1), day(k + 1), n) for i, k, n in rows], "payment_id string, settles_on date, win_low date, win_high date, net_paise long").withColumn("amount_paise", F.col("net_paise"))
    credits = spark.createDataFrame([("late", day(6), 1500_00), ("own", day(6), 1600_01), ("short", day(8), 1700_00), ("far", day(15), 400_00)], "credit_id string, landed_on date, amount_paise long")
    got = {r.payment_id: (r.credit_id, r.stage) for r in attribution.attribute(payments, credits).collect()}
    assert got == {"a": ("late", "whole_date"), "b": ("late", "whole_date"), "c": ("own", "whole_date"), "d": ("own", "whole_date"), "e": ("short", "single"), "f": ("short", "single")}
    assert attribution.attribute(payments.limit(0), credits).count() == 0 and attribution.attribute(payments, credits.limit(0)).count() == 0


@pytest.mark.parametrize("n, ways", [(5, 2), (30, 3), (200, 2), (900, 4), (4500, 3)])
def test_many_payments_over_several_credits(spark, n, ways):
    """Payments of one date, dealt at random: each credit gets payments that add up to it, however many there are."""
    pick = np.random.default_rng(n)
    nets = pick.integers(10_000, 5_000_000, n)
    owner = pick.integers(0, ways, n)
    owner[:ways] = np.arange(ways)
    day = datetime.date(2026, 1, 5)
    payments = spark.createDataFrame([(f"p{k:05d}", day, int(x)) for k, x in enumerate(nets)], "payment_id string, settles_on date, net_paise long")
    targets = {f"c{w}": int(nets[owner == w].sum()) for w in range(ways)}
    credits = spark.createDataFrame([(c, day, t) for c, t in targets.items()] + [("alone", datetime.date(2026, 1, 6), 5)], "credit_id string, landed_on date, amount_paise long")
    found = attribution.by_several_credits(payments, credits).collect()
    assert len({r.payment_id for r in found}) == len(found) == n
    got = {c: sum(int(nets[int(r.payment_id[1:])]) for r in found if r.credit_id == c) for c in targets}
    slack = attribution.SLACK_EACH * n + attribution.SLACK
    assert all(abs(got[c] - t) <= ways * slack for c, t in targets.items()) and all(r.exact for r in found)


def test_credits_that_cannot_be_met_get_nothing(spark):
    day = datetime.date(2026, 1, 5)
    payments = spark.createDataFrame([("a", day, 100_000), ("b", day, 300_000)], "payment_id string, settles_on date, net_paise long")
    one = spark.createDataFrame([("c1", day, 200_000), ("c2", day, 200_000)], "credit_id string, landed_on date, amount_paise long")
    assert attribution.by_several_credits(payments, one).count() == 0
    other = spark.createDataFrame([("c1", day, 100_000), ("c2", day, 900_000)], "credit_id string, landed_on date, amount_paise long")
    assert [tuple(r)[:2] for r in attribution.by_several_credits(payments, other).collect()] == [("a", "c1")]
    assert attribution.by_several_credits(payments.limit(0), one).count() == 0


def test_levels(spark):
    rows = spark.createDataFrame([(1000000, b) for b in (1000000, 980000, 800000, 100000, 0)], "a long, b long")
    assert [r.x for r in rows.select(linkage.amount_level("a", "b").alias("x")).collect()] == [linkage.EXACT, linkage.STRONG, linkage.WEAK, linkage.DIFFER, linkage.MISSING]
    rows = spark.createDataFrame([("ABC", "ABC"), ("XABC", "ABC"), ("1123456789", "2123456789"), ("ABC", "DEF"), (None, "A"), ("12345678", "1234")], "a string, b string")
    assert [r.x for r in rows.select(linkage.reference_level("a", "b").alias("x")).collect()] == [3, 2, 1, 0, 4, 2]


def test_fit_learns_weights():
    counts = [((3, 3, 3, 3, 4), 200), ((3, 2, 3, 2, 4), 60), ((0, 0, 1, 1, 4), 3000), ((0, 1, 0, 0, 4), 2500), ((0, 0, 0, 1, 4), 4000)]
    model = linkage.fit(counts)
    assert model.converged and model.bits(0, linkage.EXACT) > 5 and model.bits(0, linkage.DIFFER) < 0 and model.bits(4, linkage.MISSING) == 0
    assert abs(model.bits(0, 3)) <= linkage.MOST_BITS and linkage.fit([]).m[0] == [0.25] * 4


def test_rates_are_found_and_gated():
    draw = np.random.default_rng(1)
    names, rates = ["card_credit", "netbanking", "wallet"], [0.0236, 0.0206, 0.026]
    rows = []
    for k in range(60):
        gross = draw.integers(10**6, 10**8, 3)
        row = {m: 0 for m in waterfall.MDR_BPS} | dict(zip(names, map(int, gross)))
        row["withheld_paise"] = float(gross @ rates) + (3e6 if k % 17 == 0 else 0)
        rows.append(row)
    fit = waterfall.fit_rates(rows)
    assert all(abs(fit["rates_bps"][m] - 10_000 * r) < 15 for m, r in zip(names, rates)) and fit["identifiable"] == names
    assert waterfall.fit_rates(rows[:2]) == {}


def test_remainders(spark):
    rows = spark.createDataFrame([(-50000, 1000000), (-10000, 1000000), (-100000, 1000000), (7, 1000000), (5, 0)], "r long, g long")
    assert [x.c for x in rows.select(waterfall.remainder_class("r", "g").alias("c")).collect()] == ["rolling_reserve", "chargeback_hold", "short_pay", "over_pay", "unknown"]


def test_calibration_refuses_without_evidence(spark):
    few = spark.createDataFrame([(0.9, True)] * 29, "confidence double, correct boolean")
    assert calibration.calibrate(few, [0.05]).first().threshold is None
    wrong = spark.createDataFrame([(0.9, k % 2 == 0) for k in range(200)], "confidence double, correct boolean")
    assert calibration.calibrate(wrong, [0.01]).first().threshold is None
    good = spark.createDataFrame([(0.99, True)] * 300 + [(0.5, False)] * 20, "confidence double, correct boolean")
    assert calibration.calibrate(good, [0.05]).first().threshold == 0.99


def test_claims_and_merge(spark):
    schema = "match_id string, relation string, gateway_ids array<string>, bank_ids array<string>, ledger_ids array<string>, links array<struct<gateway_id:string,ledger_id:string>>"
    groups = spark.createDataFrame([("m1", "pays_invoice", ["g1"], [], ["l1"], [("g1", "l1")]), ("m2", "settles_into", ["g1", "g2"], ["b1"], [], []), ("m3", "settles_into", ["g2"], ["b2"], [], [])], schema)
    found = matching.claims(groups)
    assert {(r.relation, r.row_id) for r in matching.double_claims(found).collect()} == {("settles_into", "g2")}
    assert {r.match_id for r in matching.refuse_claimed(groups.where("match_id != 'm3'"), matching.claims(groups.where("match_id = 'm3'"))).collect()} == {"m1"}
    assert {tuple(r) for r in matching.claimed_pairs(groups.where("match_id = 'm1'")).collect()} == {("g1", "l1")}


def test_uniqueness_is_judged_before_acceptance(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], "l string, k int")
    right = spark.createDataFrame([("x", 1), ("y", 2), ("z", 2), ("w", 3)], "r string, k int")
    assert {(r.l, r.r) for r in matching.unique_matches(left, right, "l", "r", ["k"]).collect()} == {("a", "x"), ("c", "w")}


def test_blocks_never_pair_within_a_source_and_drop_oversize(spark):
    rows = spark.createDataFrame([(f"r{k}", "ab"[k % 2], ["hot", f"k{k // 2}"]) for k in range(40)], "row_id string, source string, keys array<string>")
    keys = blocking.keyed(rows)
    pairs = blocking.block_pairs(keys, most=30)
    assert pairs.count() == 20 and [r.key for r in blocking.oversized(keys, 30).collect()] == ["hot"]
    assert blocking.possible_pairs(rows).first().possible == 400


def test_severity_and_consensus(spark):
    rows = spark.createDataFrame([("missing_in_bank", 1), ("fee_mdr", 10**9), ("short_pay", 10**7), ("short_pay", 10**6), ("short_pay", 5)], "exception_type string, amount_paise long")
    assert [r.s for r in rows.select(exceptions.severity().alias("s")).collect()] == ["high", "info", "high", "medium", "low"]
    votes = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "a"), ("q", "b"), ("q", "a")], "row_id string, decision string")
    assert {r.row_id: r.decision for r in exceptions.consensus(votes, least_agreement=0.6).collect()} == {"r": "a", "q": "abstain"}


def test_policy_boundaries_and_budget(spark):
    columns = "run_id int, seq int, amount_paise long, currency string, confidence double, reason string, evidence_count int, human_approved boolean, action_class string"
    base = [(1, k, a, "INR", 0.95, "r", 1, False, "post_entry") for k, a in enumerate([2_500_000, 2_500_001, 20_000_001, 100, 100])]
    rows = spark.createDataFrame([*base, (1, 9, 1, "USD", 0.95, "r", 1, True, "post_entry"), (1, 10, 1, "INR", 0.95, "r", 1, True, "move_money")], columns)
    decided = policy.rules(rows, policy.Policy())
    assert [r.verdict for r in decided.orderBy("seq").collect()] == ["auto_approved", "needs_human", "denied", "auto_approved", "auto_approved", "denied", "denied"]
    posted = {r.seq: r.posted for r in policy.within_budget(decided, policy.Policy(run_cap_paise=2_500_100)).collect()}
    assert posted == {0: True, 1: False, 2: False, 3: True, 4: False, 9: False, 10: False}
    assert {r.verdict for r in policy.rules(rows, policy.Policy(kill_switch=True)).collect()} == {"denied"}


@pytest.mark.parametrize("folded, rounds", [(0, 40), (0, 2), (10**6, 40)])
def test_budgets_by_running_sums_equal_the_fold(spark, monkeypatch, folded, rounds):
    monkeypatch.setattr(policy, "FOLDED", folded)
    monkeypatch.setattr(policy, "ROUNDS", rounds)
    monkeypatch.setattr(policy, "STRETCH", 7)
    pick = np.random.default_rng(6)
    rows = [(r, int(k) * 3, int(pick.integers(1, 400)) * (-1) ** k, "auto_approved" if pick.random() < 0.8 else "denied") for r in range(3) for k in range(60)]
    caps = policy.Policy(run_cap_paise=3000, run_cap_count=18)
    want, state = {}, {}
    for r, k, a, v in sorted(rows):
        total, n = state.get(r, (0, 0))
        want[r, k] = v == "auto_approved" and total + abs(a) <= 3000 and n < 18
        state[r] = (total + abs(a), n + 1) if want[r, k] else (total, n)
    decided = spark.createDataFrame(rows, "run_id int, seq long, amount_paise long, verdict string")
    assert {(r.run_id, r.seq): r.posted for r in policy.within_budget(decided, caps).collect()} == want
    assert policy.within_budget(decided.limit(0), caps).count() == 0


def test_run_caps_join_the_verdict(spark):
    columns = "run_id int, seq long, amount_paise long, currency string, confidence double, reason string, evidence_count int, human_approved boolean, action_class string"
    rows = spark.createDataFrame([(1, k, a, "INR", 0.95, "r", 1, False, "post_entry") for k, a in enumerate([60, 50, 3_000_000, 40, 1])], columns)
    got = {r.seq: (r.failed, r.verdict) for r in policy.verdicts(rows, policy.Policy(run_cap_paise=100)).collect()}
    assert got == {0: ([], "auto_approved"), 1: (["run_caps"], "denied"), 2: (["materiality"], "needs_human"), 3: ([], "auto_approved"), 4: (["run_caps"], "denied")}


@pytest.mark.parametrize("seed", range(4))
def test_merging_a_stage_equals_one_after_the_other(spark, seed):
    pick = np.random.default_rng(seed)
    groups = [(f"m{k:03d}", float(pick.integers(0, 5))) for k in range(120)]
    claims = {m: {(f"r{pick.integers(2)}", f"x{pick.integers(60)}") for _ in range(pick.integers(0, 4))} for m, _ in groups}
    want, held = {}, set()
    for m, _ in sorted(groups, key=lambda g: (-g[1], g[0])):
        want[m] = not claims[m] & held
        held |= claims[m] if want[m] else set()
    df = spark.createDataFrame(groups, "match_id string, confidence double")
    claimed = spark.createDataFrame([(m, *c) for m, own in claims.items() for c in own], "match_id string, relation string, row_id string")
    assert {r.match_id: r.accepted for r in matching.merged(df, claimed, [-F.col("confidence")]).collect()} == want
    assert matching.merged(df.limit(0), claimed, [-F.col("confidence")]).count() == 0


def test_bootstrap_of_a_ratio_is_close_to_drawing_rows(spark):
    pick = np.random.default_rng(9)
    whole = pick.integers(1, 50, 3000)
    part = pick.binomial(whole, 0.3)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(part, whole)], "a long, b long")
    low, high = evaluation.ratio_interval(rows.repartition(7), "a", "b")
    assert (low, high) == evaluation.ratio_interval(rows.repartition(1), "a", "b")
    at = pick.integers(0, 3000, (2000, 3000))
    drawn = part[at].sum(axis=1) / whole[at].sum(axis=1)
    assert abs(low - np.quantile(drawn, 0.025)) < 0.0015 and abs(high - np.quantile(drawn, 0.975)) < 0.0015
    assert evaluation.ratio_interval(rows.limit(0), "a", "b") is None
    same = evaluation.ratio_interval(spark.createDataFrame([(1, 1)] * 100, "a long, b long"), "a", "b")
    assert same == (1.0, 1.0)


def plain_root(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256(b"\x01" + hashes[k] + hashes[k + 1]).digest() if k + 1 < len(hashes) else hashes[k] for k in range(0, len(hashes), 2)]
    return hashes[0] if hashes else hashlib.sha256(b"").digest()


def plain_leaves(n):
    return [hashlib.sha256(b"\x00" + f"r{k}".encode()).digest() for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 13, 1030])
def test_merkle_root_and_proofs(spark, n):
    hashes = plain_leaves(n)
    leaves = audit.leaves(spark.createDataFrame([(k, f"r{k}") for k in range(n)], "n long, record string"), "n", "record")
    expected = plain_root(hashes)
    assert audit.root(leaves, n).first().root == expected.hex()
    tree = audit.new_nodes(leaves, 0, n).cache()
    assert audit.root_of(tree, n) == expected.hex()
    got = {r.seq: [(s.side, bytes.fromhex(s.hash)) for s in r.path] for r in audit.inclusion_proofs(tree, leaves, n).collect()}
    assert sorted(got) == list(range(n))
    for k, path in got.items():
        assert audit.verify_inclusion(hashes[k], path, expected) and not audit.verify_inclusion(b"x" * 32, path, expected) and len(path) <= max(n - 1, 0).bit_length()
    proven = audit.inclusion_proofs(tree, leaves, n).join(leaves, "seq").select(audit.proven_root("leaf_hash", "path").alias("root")).distinct().collect()
    assert [r.root for r in proven] == ([expected.hex()] if n else [])
    for size in {0, 1, n // 3, n // 2, n}:
        if size <= n:
            was = plain_root(hashes[:size])
            assert audit.root_of(tree, size) == was.hex() and audit.verify_consistency(size, was, n, expected, audit.consistency_proof(tree, size, n))


def test_tampering_is_located(spark):
    records = spark.createDataFrame([(k, f"r{k}") for k in range(6)], "seq long, record string")
    log = records.withColumn("leaf_hash", audit.leaf_hash("record"))
    assert audit.first_tampered(log, "record").first().first_tampered is None
    changed = log.selectExpr("seq", "IF(seq = 3, 'other', record) AS record", "leaf_hash")
    assert audit.first_tampered(changed, "record").first().first_tampered == 3
    assert audit.first_tampered(log.where("seq != 2"), "record").first().first_tampered == 2
    signature = audit.sign_head(6, "ab", "now", b"key")
    assert audit.verify_head(6, "ab", "now", b"key", signature) and not audit.verify_head(7, "ab", "now", b"key", signature)


def test_models_beat_nothing_and_stay_finite():
    t = np.arange(150)
    v = 1000 + 5.0 * t + 300 * (t % 7 == 2)
    for name, model in forecast.MODELS.items():
        ahead = model(v, 14)
        assert ahead.shape == (14,) and np.isfinite(ahead).all(), name
        assert np.abs(ahead - (1000 + 5.0 * (150 + np.arange(14)) + 300 * ((150 + np.arange(14)) % 7 == 2))).mean() < 200, name


def test_interval_and_metrics():
    low, high = evaluation.proportion_interval(90, 100)
    assert 0.8 < low < 0.9 < high < 0.97 and evaluation.proportion_interval(0, 0) == (0.0, 0.0)
    assert evaluation.metrics_text({"b": 1 / 3, "a": 2}) == '{\n  "a": 2,\n  "b": 0.333333\n}\n'


def test_rates_fit_all_settlements(spark):
    pick, rows = np.random.default_rng(4), []
    methods = sorted(waterfall.MDR_BPS)
    for k in range(6000):
        gross = pick.integers(10_000, 5_000_000, len(methods))
        rows.append({m: int(g) for m, g in zip(methods, gross)} | {"withheld_paise": int(gross @ np.linspace(0.004, 0.03, len(methods))) + (3_000_000 if k % 17 == 0 else 0)})
    want, got = waterfall.fit_rates(rows), waterfall.fit_rates_over(spark.createDataFrame(rows))
    assert got["identifiable"] == want["identifiable"] and abs(got["r2"] - want["r2"]) < 1e-6
    assert all(abs(got[x][m] - want[x][m]) < 1e-3 for x in ("rates_bps", "shares") for m in methods)
    assert waterfall.fit_rates_over(spark.createDataFrame(rows[:2])) == {} == waterfall.fit_rates_over(spark.createDataFrame(rows).limit(0))


def test_consistency_proofs(spark):
    hashes = plain_leaves(41)
    tree = audit.new_nodes(spark.createDataFrame([(k, f"r{k}") for k in range(41)], "seq long, record string").select("seq", audit.leaf_hash("record").alias("leaf_hash")), 0, 41)
    held = tree.coalesce(1).cache()
    for size in (0, 3, 17, 32, 41):
        new = plain_root(hashes[:size])
        for old in {0, 1, 2, size // 2, max(size - 1, 0), size}:
            if old <= size:
                was, path = plain_root(hashes[:old]), audit.consistency_proof(held, old, size)
                assert audit.verify_consistency(old, was, size, new, path)
                if old:
                    assert not audit.verify_consistency(old, hashlib.sha256(b"x").digest(), size, new, path)
                if 0 < old < size:
                    forged = ([hashlib.sha256(b"y").digest(), *path[0][1:]], path[1])
                    assert not audit.verify_consistency(old, was, size, new, forged)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1023, 1024, 1025, 3000])
def test_root_by_subtrees_equals_the_plain_tree(spark, n):
    rows = spark.createDataFrame([(k, f"r{k}") for k in range(n)], "seq long, record string")
    want = plain_root(plain_leaves(n)).hex()
    assert audit.root(audit.leaves(rows, "seq", "record"), n).first()["root"] == want


def test_append_only_log(spark, tmp_path):
    folder, key = str(tmp_path / "books"), b"k"
    rows = spark.createDataFrame([(k * 7, f"r{k}") for k in range(30)], "at_no long, record string")
    assert audit.append(spark, folder, rows.where("at_no < 100"), "at_no", "one", "2026-01-01", key) == 15
    assert audit.append(spark, folder, rows.where("at_no >= 100"), "at_no", "two", "2026-01-02", key) == 30
    with pytest.raises(AnalysisException):
        audit.append(spark, folder, rows, "at_no", "two", "2026-01-03", key)
    assert audit.verify(spark, folder, key) == {"sound": True, "first_tampered": None, "signatures": True, "roots": True, "nodes": True, "whole": True}
    assert [r.seq for r in audit.page(audit.read_log(spark, folder), "two", 17, 5).collect()] == [18, 19, 20, 21, 22]
    assert not audit.verify(spark, folder, b"other")["signatures"]
    changed = audit.read_log(spark, folder).withColumn("record", F.when(F.col("seq") == 4, "forged").otherwise(F.col("record"))).cache()
    assert audit.first_tampered(changed, "record").first()["first_tampered"] == 4


def test_append_and_verify_go_on_from_the_last_head(spark, tmp_path):
    folder, key = str(tmp_path / "books"), b"k"
    rows = lambda a, b: spark.createDataFrame([(k, f"r{k}") for k in range(a, b)], "at_no long, record string")
    ends = [0, 1, 1027, 1030, 2500]
    for run, (a, b) in enumerate(itertools.pairwise(ends)):
        assert audit.append(spark, folder, rows(a, b), "at_no", f"run{run}", "now", key) == b
        assert audit.root_of(audit.read_tree(spark, folder), b) == plain_root(plain_leaves(b)).hex()
    heads = {r["size"]: r["root"] for r in audit.read_heads(spark, folder).collect()}
    stored = audit.read_tree(spark, folder).groupBy("level", "index").count()
    assert stored.where("count > 1").count() == 0 and stored.count() == sum(2500 >> k for k in range(12))
    assert audit.verify(spark, folder, key)["sound"] and audit.verify(spark, folder, key, (1030, heads[1030]))["sound"]
    assert not audit.verify(spark, folder, key, (1030, heads[1027]))["roots"]
    # A crash before the head: the records are there, their nodes perhaps, the head is not.
    audit.numbered(rows(2500, 2600), "at_no", 2500).select("seq", "record", audit.leaf_hash("record").alias("leaf_hash"), F.lit("now").alias("at")).write.parquet(f"{folder}/log/run=lost")
    assert audit.append(spark, folder, rows(2600, 2610), "at_no", "next", "later", key) == 2610
    got = audit.verify(spark, folder, key, (2500, heads[2500]))
    assert got["sound"] and {r.run for r in audit.read_heads(spark, folder).where("size > 2500").collect()} == {"lost", "next"}
    assert audit.verify(spark, folder, key)["sound"]
    # A record changed after the trusted head is found by reading the later runs only; one before it by reading all.
    late = audit.read_log(spark, folder).where("run = 'next'").withColumn("record", F.when(F.col("seq") == 2605, "forged").otherwise(F.col("record"))).drop("run").collect()
    spark.createDataFrame(late, "seq long, record string, leaf_hash string, at string").write.mode("overwrite").parquet(f"{folder}/log/run=next")
    assert audit.verify(spark, folder, key, (2500, heads[2500]))["first_tampered"] == 2605
    assert audit.append(spark, folder, rows(0, 0), "at_no", "none", "later", key) == 2610


def test_currency_is_asserted(spark):
    rows = spark.createDataFrame([(5, "INR"), (7, "USD")], "a long, c string")
    assert rows.where("c = 'INR'").select(money.of_currency(F.col("a"), "c").alias("x")).first().x == 5
    with pytest.raises(Exception, match="not in INR: USD"):
        rows.select(money.of_currency(F.col("a"), "c").alias("x")).collect()


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    names = [(f"c{k}", "a", f"Customer {k % 37} {chr(97 + k % 5)}") for k in range(120)] + [(f"s{k}", "b", f"Supplier {k}") for k in range(50)] + [(f"t{k}", "c", f"Trader {k} {chr(97 + k % 5)}") for k in range(20)]
    vectors = blocking.gram_vectors(spark.createDataFrame(names, "row_id string, source string, t string"), "t").cache()
    whole = sorted(map(tuple, blocking.nearest(vectors, 4).collect()))
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 16)
    assert sorted(map(tuple, blocking.nearest(vectors, 4).collect())) == whole
    own: dict = {}
    for r in vectors.collect():
        own.setdefault((r.source, r.row_id), {})[r.bucket] = r.weight
    want = []
    for (source, row), v in own.items():
        for other in {s for s, _ in own if s > source}:
            near = [(-round(sum(w * u.get(b, 0) for b, w in v.items()), 6), i) for (s, i), u in own.items() if s == other]
            want += [(row, i, -x) for x, i in sorted(near)[:4] if -x >= 0.30]
    assert [x[:2] for x in sorted(want)] == [x[:2] for x in whole]


def test_data_sets_and_history(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "concat('n', id) AS name")
    manifest = {r.table: r for r in sinks.write_dataset({"a": rows, "b": rows.limit(0)}, str(tmp_path / "set")).collect()}
    assert manifest["a"].rows == 10 and manifest["b"].rows == 0 and manifest["a"].digest == sinks.digest(rows.repartition(3))
    assert spark.read.json(str(tmp_path / "set" / "manifest")).count() == 2
    history = str(tmp_path / "history")
    assert [sinks.append_history(spark, history, m, x) for m, x in (("m1", "{}"), ("m1", "{}"), ("m2", "{}"))] == [True, False, True]
    sinks.write_forecast(spark.createDataFrame([(1,)], "point long"), rows, str(tmp_path / "forecast"))
    assert not sinks.is_stale(spark, rows, str(tmp_path / "forecast")) and sinks.is_stale(spark, rows.limit(9), str(tmp_path / "forecast"))


def test_review_queue(spark):
    rows = spark.createDataFrame([(k, float(k), "review" if k % 2 else "link") for k in range(20)], "p long, bits double, band string")
    assert [r.p for r in exceptions.review_queue(rows, 3, "p").collect()] == [19, 17, 15]


def test_break_even_rounds_once(spark):
    """268500 / 2334790 is 0.11499964: six places first would make it 0.115 and then 0.12."""
    rows = spark.createDataFrame([(537, 0, 0, 0, (2334790 - 45000) * 20)], "rows long, exceptions long, reviews long, missed long, exposed_paise long")
    assert evaluation.break_even(rows).first()["break_even"] == 0.11


def test_fitted_card_falls_back_to_the_contract():
    fit = {"rates_bps": {"card_credit": 246.0, "upi": 10.0, "wallet": 900.0}, "shares": {"card_credit": 0.6, "upi": 0.37, "wallet": 0.03}, "identifiable": ["card_credit", "upi"]}
    card = {m: (bps, sure) for m, _, _, _, bps, sure in waterfall.fitted_card(fit)}
    assert card["card_credit"] == (200, True) and card["upi"] == (0, True) and card["wallet"] == (money.MDR_BPS["wallet"], False)
    assert {m: b for m, (b, _) in {m: (bps, 0) for m, _, _, _, bps, _ in waterfall.fitted_card({})}.items()} == money.MDR_BPS


def test_dates_by_relation(spark):
    day = datetime.date
    rows = [(False, True, day(2026, 3, 2), day(2026, 3, 4)), (False, True, day(2026, 3, 2), day(2026, 3, 5)), (False, True, day(2026, 3, 2), day(2026, 3, 10)), (False, True, day(2026, 3, 2), day(2026, 3, 20)), (False, False, day(2026, 3, 2), day(2026, 3, 4)), (True, False, day(2026, 3, 4), day(2026, 3, 2)), (True, True, day(2026, 3, 4), day(2026, 3, 4)), (None, True, day(2026, 3, 4), day(2026, 3, 4))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, b1 boolean, b2 boolean, x date, y date")
    side = lambda n, d: df.select(F.concat(F.lit(f"{n}_"), "k").alias(f"id{n}"), F.col(f"b{n}").alias("at_bank"), F.lit(None).cast("string").alias("reference"), F.lit(5).cast("long").alias("amount_paise"), F.col(d).alias("occurred_on"), F.lit("A").alias("counterparty"), *(F.lit(v).cast("date").alias(c) for c, v in (("settles_on", "2026-03-04"), ("win_low", "2026-03-03"), ("win_high", "2026-03-05"))))
    pairs = df.select(F.concat(F.lit("1_"), "k").alias("id1"), F.concat(F.lit("2_"), "k").alias("id2"))
    got = {int(r.id1[2:]): r.date for r in linkage.compared(pairs, side(1, "x"), side(2, "y"), "id1", "id2").collect()}
    assert got == {0: linkage.EXACT, 1: linkage.STRONG, 2: linkage.WEAK, 3: linkage.DIFFER, 4: linkage.WEAK, 5: linkage.EXACT, 6: linkage.EXACT, 7: linkage.MISSING}


def test_blocks_between_named_sources_only(spark):
    rows = spark.createDataFrame([("p", "gateway", "k"), ("i", "ledger", "k"), ("c", "bank", "k"), ("n", "bank", None)], "row_id string, source string, key string")
    pairs = lambda between: {(r.left_id, r.right_id) for r in blocking.candidates(rows, {"s": F.array("key")}, between=between).collect()}
    assert pairs(None) == {("p", "i"), ("c", "p"), ("c", "i")} and pairs({"s": [("ledger", "gateway")]}) == {("p", "i")} and pairs({"s": []}) == set()


def test_canonical_text(spark):
    df = spark.sql("SELECT 'ü\"x' AS b, 2L AS a, date'2026-03-01' AS d, timestamp'2026-03-01 05:30:00' AS t, 1.50BD AS m, map('z', 1, 'y', 2) AS n, CAST(NULL AS string) AS o, 1.5D AS f")
    made = df.select(text.canonical_json(df, ["t", "b", "a", "d", "m", "n", "o"]).alias("x")).first().x
    assert made == '{"a":2,"b":"ü\\"x","d":"2026-03-01","m":"1.50","n":{"y":2,"z":1},"o":null,"t":"2026-03-01T05:30:00.000000Z"}'
    with pytest.raises(TypeError):
        text.canonical_json(df, ["f"])


def test_candidates_are_compared_and_counted_where_they_meet(spark):
    names = ["M/S Bose Exports Pvt. Ltd.", "Bose Exports", "Basu Export", "", None, "Pillai Hardware"]
    references = ["order_1", "order_12", "UTR000123456", "XUTR000123456", "UTR000123999", "", None]
    rows = []
    for k in range(60):
        rows.append((f"r{k}", ("a", "b", "c")[k % 3], references[k % 7], (0, 100, 98, 80, None, -100)[k % 5 if k % 4 else 5], datetime.date(2026, 3, 1 + k % 11) if k % 13 else None, names[k % 6]))
    rows = spark.createDataFrame(rows, "row_id string, source string, reference string, amount_paise long, occurred_on date, counterparty string")
    keys = {"amount": F.array(F.abs("amount_paise").cast("string"), F.lit("zero")), "name": F.array("counterparty"), "day": F.array(F.dayofmonth("occurred_on").cast("string"), F.lit(None).cast("string"))}
    found = blocking.candidates(rows, keys, 55)
    pairs = {(r.left_id, r.right_id): tuple(r.why) for r in found.collect()}
    source = {r.row_id: r for r in rows.collect()}
    held = list(source.values())
    size = {c: {v: sum(getattr(r, c) == v for r in held) for v in {getattr(r, c) for r in held}} for c in ("occurred_on", "counterparty")}
    want = {}
    for a in source.values():
        for b in source.values():
            why = []
            if a.amount_paise is not None and b.amount_paise is not None and abs(a.amount_paise) == abs(b.amount_paise) and 1 < sum(abs(r.amount_paise) == abs(a.amount_paise) for r in held if r.amount_paise is not None) <= 55:
                why.append("amount")
            if a.occurred_on and a.occurred_on == b.occurred_on and size["occurred_on"][a.occurred_on] > 1:
                why.append("day")
            if a.counterparty and a.counterparty == b.counterparty and size["counterparty"][a.counterparty] > 1:
                why.append("name")
            if a.source < b.source and why:
                want[a.row_id, b.row_id] = tuple(why)
    assert pairs == want and len(pairs) == found.count()
    counts = {tuple(r.why): r.candidates for r in blocking.candidate_counts(rows, keys, 55).collect()}
    assert sum(counts.values()) == len(want) and all(n == sum(w == why for w in want.values()) for why, n in counts.items())
    asked = spark.createDataFrame([*list(want)[:9], ("r0", "r0"), ("r1", "none")], "left_id string, right_id string")
    assert {(r.left_id, r.right_id): tuple(r.why) for r in blocking.proposed(asked, rows, keys, 55).collect()} == {k: want[k] for k in list(want)[:9]}
    ids = found.select("left_id", "right_id")
    side = lambda name: rows.withColumnRenamed("row_id", name)
    levels = sorted(map(tuple, linkage.compared_candidates(rows, keys, "left_id", "right_id", 55).collect()))
    assert levels == sorted(map(tuple, linkage.compared(ids, side("left_id"), side("right_id"), "left_id", "right_id").collect()))
    patterns = {}
    for row in levels:
        patterns[row[2:]] = patterns.get(row[2:], 0) + 1
    assert {tuple(r[:5]): r.n for r in linkage.counted_candidates(rows, keys, 55).collect()} == patterns


def test_pairs_are_not_shuffled(spark):
    rows = spark.createDataFrame([("p", "a", "k"), ("i", "b", "k")], "row_id string, source string, key string")
    plan = blocking.candidates(rows, {"s": F.array("key")})._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate") and plan.index("MapInArrow") < plan.index("Exchange")


def test_credits_beyond_all_payments_are_told_at_once(monkeypatch):
    monkeypatch.setattr(subsets, "MOST_TRIES", 200)
    values, counts = np.arange(101, 131, dtype=np.int64), np.full(30, 2, np.int64)
    total = int((values * counts).sum())
    done = subsets.split(values, counts, [total // 2, total // 2 + 5000], 100)
    assert done.status == "none" and done.tried == 0
