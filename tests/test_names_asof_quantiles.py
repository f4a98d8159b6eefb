"""Misspelt names (B1), carried NAVs (B4), peers (B6) and balanced ranges."""

import datetime as dt
import itertools
import math
import random

import pytest

from navframe.operators import asof as AJ
from navframe.operators import names as N
from navframe.operators import portfolio as PF
from navframe.operators import quantiles as QT

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


# -- names ------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts(seed, n):
    """Names with repeated q-grams, of one to 24 characters, and edits of them."""
    rng = random.Random(seed)
    out = {"", "a", "ab", "aaaaaaaaaaaa", "abababababab", "ünï", "fund"}
    while len(out) < n:
        s = "".join(rng.choice("abü ") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 12, 24]))).strip()
        out.add(s)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s) + 1)
            s = rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice("abc") + s[at:], s[:at] + "c" + s[at + 1 :]]).strip()
            out.add(s)
    return sorted(out)


@pytest.mark.parametrize("distance", [1, 2])
def test_near_names_are_those_of_all_pairs(spark, distance):
    a, b = texts(1, 160), texts(2, 160)
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    got = {(r.given, r.listed): r.distance for r in N.near_names(frame(a), frame(b), distance).collect()}
    assert got == {(x, y): d for x, y in itertools.product(a, b) if (d := edits(x, y)) <= distance}


def test_every_given_name_comes_out(spark):
    schemes = spark.createDataFrame(
        [(10, "Alpha Growth Fund"), (11, "Alpha Growth Fund"), (20, "Beta Income"), (21, "Beta Incomes"), (30, None)], "scheme_code bigint, scheme_name string"
    )
    rows = [(1, "alpha growth fund ", 60.0), (1, "Alpha Grwth Fund", 10.0), (1, "Beta Income!", 30.0), (1, "Beta Incomex", 1.0), (2, "Gamma", 5.0), (2, None, 7.0)]
    given = spark.createDataFrame(rows, "portfolio_id bigint, scheme_name string, value double")
    got = {r.scheme_name: (r.status, r.scheme_code, r.distance, r.n_candidates) for r in N.resolve_names(given, schemes).collect()}
    assert got == {
        "alpha growth fund ": ("exact", 10, 0, 1),
        "Alpha Grwth Fund": ("corrected", 10, 1, 1),
        "Beta Income!": ("ambiguous", None, 1, 2),
        "Beta Incomex": ("ambiguous", None, 1, 2),
        "Gamma": ("unknown", None, None, 0),
        None: ("unknown", None, None, 0),
    }
    coded, left = N.positions_by_name(given, schemes)
    assert sorted((r.portfolio_id, r.scheme_code, r.value) for r in coded.collect()) == [(1, 10, 10.0), (1, 10, 60.0)]
    assert sorted((r.value, r.status) for r in left.collect()) == [(1.0, "ambiguous"), (5.0, "unknown"), (7.0, "unknown"), (30.0, "ambiguous")]


# -- as-of --------------------------------------------------------------------------------


def test_asof_join_equals_brute_force(spark):
    rng = random.Random(3)
    known = [(k, day(d), float(d), None if rng.random() < 0.2 else f"t{d}") for k in (1, 2) for d in rng.sample(range(60), 12)]
    asked = [(k, day(rng.randrange(70)), i) for k in (1, 2, 3) for i in range(40)] + [(1, day(5), 900), (1, day(5), 901)]
    a = spark.createDataFrame(asked, "k bigint, at date, no int")
    b = spark.createDataFrame(known, "k bigint, at date, x double, t string")
    for gap in (None, 0, 4):
        got = sorted((tuple(r) for r in AJ.asof_join(a, b, "k", "at", ["x", "t"], gap).collect()), key=repr)
        want = []
        for k, at, no in asked:
            last = max((r for r in known if r[0] == k and r[1] <= at), key=lambda r: r[1], default=None)
            if last and (gap is None or (at - last[1]).days <= gap):
                want.append((k, at, no, last[2], last[3], last[1]))
            else:
                want.append((k, at, no, None, None, None))
        assert got == sorted(want, key=repr)


def test_values_carry_navs_up_to_the_gap(spark):
    nav = spark.createDataFrame(
        [(10, day(i), 100.0 + i) for i in range(12)] + [(20, day(0), 5.0), (20, day(9), 6.0), (30, day(2), None)], "scheme_code bigint, nav_date date, nav double"
    )
    units = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (2, 20, 1.0), (3, 30, 1.0), (1, None, 9.0)], "portfolio_id bigint, scheme_code bigint, units double")
    for holders in (1, 50_000):
        got = {(r.portfolio_id, (r.nav_date - D0).days): r for r in AJ.portfolio_value(units, nav, day(11), 1, 7, holders).collect()}
        assert (got[1, 7].portfolio_value, got[1, 7].n_carried, got[1, 7].n_unpriced) == (117.0, 1, 0)  # carried seven days
        assert (got[1, 8].portfolio_value, got[1, 8].n_priced, got[1, 8].n_unpriced) == (108.0, 1, 1)  # one too many
        assert (got[1, 9].portfolio_value, got[1, 9].n_carried) == (121.0, 0)
        assert {d for p, d in got if p == 2} == {*range(8), 9, 10, 11} and not [p for p, _ in got if p == 3]

def test_values_are_summed_where_the_portfolios_are(spark, monkeypatch):
    """Each block of days is summed without an exchange; the result is the written blocks."""
    plans = []
    real = AJ.stored_blocks
    seen = lambda blocks: (plans.append(b._jdf.queryExecution().executedPlan().toString()) or b for b in blocks)
    monkeypatch.setattr(AJ, "stored_blocks", lambda blocks, schema, held: real(seen(blocks), schema, held))
    nav = spark.createDataFrame([(10, D0 + dt.timedelta(days=i), 10.0 + i) for i in range(5)], "scheme_code bigint, nav_date date, nav double")
    units = spark.createDataFrame([(p, 10, float(p)) for p in range(1, 4)], "portfolio_id bigint, scheme_code bigint, units double")
    out = AJ.portfolio_value(units, nav, D0 + dt.timedelta(days=4), 1, 7, 2)
    assert len(plans) == 3 and all("hashpartitioning(portfolio_id" not in p for p in plans)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.portfolio_id, (r.nav_date - D0).days): r.portfolio_value for r in out.collect()} == {(p, i): p * (10.0 + i) for p in range(1, 4) for i in range(5)}



# -- quantiles and ranges --------------------------------------------------------------------


def test_kth_values_equal_sorted_ones(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.randrange(-(2**40), 2**40), 7, 7, -5, 0])) for g in ("a", "a", "a", "b", None) for _ in range(80)]
    df = spark.createDataFrame([*rows, ("a", None), ("c", None)], "g string, v bigint")
    sizes = {g: sorted(v for h, v in rows if h == g) for g in ("a", "b", None)}
    wanted = [(g, k) for g, vs in sizes.items() for k in (1, 2, 40, len(vs) - 1, len(vs), len(vs) + 1)] + [("c", 1)]
    got = QT.kth_values(df, "g", "v", spark.createDataFrame(wanted, "g string, k bigint")).collect()
    assert {(r.g, r.k): r.v for r in got} == {(g, k): sizes[g][k - 1] for g, k in wanted if g in sizes and k <= len(sizes[g])}
    assert QT.kth_values(df.filter("v IS NULL"), "g", "v", spark.createDataFrame(wanted, "g string, k bigint")).count() == 0


def test_peers_of_a_large_house(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.uniform(-9, 30), 6)) for i in range(300)]
    metrics = spark.createDataFrame([*rows, (900, None)], "scheme_code bigint, cagr_percent double").repartition(6)
    house = lambda i: "large" if i < 200 else f"h{i % 7}"
    schemes = spark.createDataFrame([(i, house(i)) for i in [*range(300), 900]], "scheme_code bigint, fund_house string")
    out = PF.peer_underperformance(metrics, schemes)
    for r in out.collect():
        peers = sorted(v for i, v in rows if house(i) == r.fund_house)
        quartile = peers[max(math.ceil(0.25 * len(peers)), 1) - 1]
        assert (r.n_peers, round(r.peer_quartile, 6), r.underperforming) == (len(peers), quartile, r.cagr_percent < quartile)
    assert out.count() == 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    counted = spark.conf.get("spark.sql.adaptive.enabled")
    assert counted and plan.count("partial_count") + plan.count("count(1)") >= 1


def test_ranges_of_skewed_codes_are_balanced(spark):
    rng = random.Random(6)
    codes = [int(2 ** rng.uniform(0, 50)) for _ in range(4000)]
    df = spark.createDataFrame([(c,) for c in codes] + [(None,)], "code bigint")
    ranges = QT.key_ranges(df, "code", 10)
    predicates = QT.range_predicates("code", ranges)
    sizes = [df.filter(p).count() for p in predicates]
    assert sum(sizes) == 4001 and len(sizes) == 10  # every row in one range
    assert max(sizes) <= 2 * 400.1
    equal = spark.createDataFrame([(5,)] * 30 + [(9,)], "code bigint")
    assert sum(equal.filter(p).count() for p in QT.range_predicates("code", QT.key_ranges(equal, "code", 4))) == 31
    assert QT.key_ranges(df.filter("code IS NULL"), "code", 4) == [(None, None)]
