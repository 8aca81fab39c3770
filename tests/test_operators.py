import pytest
from pyspark.sql import functions as F

from stocktide.functions import total
from stocktide.operators import joining as J
from stocktide.operators import ordering as O
from stocktide.operators import reshaping as S
from stocktide.operators import windows as W


@pytest.mark.parametrize("right,want", [([1, 2], [3]), ([1, None], []), ([], [1, 2, 3, None]), ([None], [])])
def test_not_in_null_rules(make, rows, right, want):
    left = make([1, 2, 3, None], "k int")
    assert [r[0] for r in rows(J.not_in(left, "k", make(right, "v int"), "v"))] == want


def test_not_in_matches_sql(spark, make, rows):
    left, right = make([1, 2, 2, 5], "k int"), make([2, 2], "v int")
    left.createOrReplaceTempView("l"), right.createOrReplaceTempView("r")
    assert rows(J.not_in(left, "k", right, "v")) == rows(spark.sql("select k from l where k not in (select v from r)"))


def test_share_of_group_sums_to_one(make):
    df = make([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 5.0)], "g string, v double")
    out = J.share_of_group(df, ["g"], "v", "s")
    assert out.count() == 4
    assert all(abs(r["t"] - 1) < 1e-12 for r in out.groupBy("g").agg(total("s").alias("t")).collect())


def test_duplicates_found_and_reported(make, rows):
    df = make([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert rows(J.duplicate_keys(df, ["k"])) == [(1, 2)]
    with pytest.raises(J.DuplicateKeyError):
        J.assert_unique(df, ["k"])
    facts = make([1, 2, 3], "k int")
    assert J.enrich(facts, df, ["k"], "keep").count() == 4
    with pytest.raises(J.DuplicateKeyError):
        J.enrich(facts, df, ["k"], "error")


def test_salted_join_equals_plain_join(make, rows):
    left = make([("d1", n) for n in range(40)] + [("d2", 1), (None, 2)], "d string, n int")
    right = make([("d1", "t1"), ("d1", "t2"), ("d3", "t3")], "d string, t string")
    assert rows(J.salted_join(left, right, ["d"], ["n"], 5)) == rows(left.join(right, "d"))
    assert rows(J.salted_join(left, right, ["d"], ["n"], 5, "left")) == rows(left.join(right, "d", "left"))


def test_window_join_includes_both_ends_and_overlaps(make, rows):
    days = make([("p", f"2023-01-0{d}") for d in range(1, 6)], "k string, d string").withColumn("d", F.col("d").cast("date"))
    wins = make([("p", "2023-01-02", "2023-01-03", "c"), ("p", "2023-01-03", "2023-01-04", "r")], "k string, s string, e string, m string")
    wins = wins.select("k", F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"), "m")
    got = [(r["d"].day, r["m"]) for r in J.within_window(days, wins, "k", "d", "s", "e").orderBy("d", "m").collect()]
    assert got == [(1, None), (2, "c"), (3, "c"), (3, "r"), (4, "r"), (5, None)]


def test_later_pairs_against_brute_force(make, rows):
    data = [(e, p, float(a)) for e, p, a in
            [(1, 1, 5), (1, 2, 5), (1, 3, 4), (2, 1, 1), (2, 3, 9), (3, 2, 2), (None, 1, 7), (None, 2, 8)]] + [(4, 1, None), (4, 2, 3.0)]
    df = make(data, "e int, p int, a double")
    for amount in (None, "a"):
        want = []
        for e, p, a in data:
            hits = [q for f, q, b in data if e is not None and e == f and q >= p and (amount is None or (a is not None and b is not None and b >= a))]
            want += [(e, p, q) for q in hits] or [(e, p, None)]
        key = lambda t: tuple((v is None, v or 0) for v in t)
        assert sorted(map(tuple, J.later_pairs(df, ["e"], "p", amount).collect()), key=key) == sorted(want, key=key)


SHEET = [(0, None), (1, "a"), (2, None), (3, None), (4, "b"), (5, "a"), (6, None), (7, None), (8, None), (9, "c"), (10, None)]


@pytest.mark.parametrize("block", [1, 2, 3, 4, 100])
def test_fill_down_over_blocks(make, rows, block):
    df = make(SHEET, "pos long, k string")
    want, last = [], None
    for pos, k in SHEET:
        last = k or last
        if last:
            want.append((pos, last))
    once = W.fill_down(df, "k", "pos", block_rows=block)
    assert rows(once) == want
    assert rows(W.fill_down(once, "k", "pos", block_rows=block)) == want  # filling again changes nothing


def test_fill_down_per_source_keeps_leading_rows_on_request(make, rows):
    df = make([("f1", 0, "a"), ("f1", 1, None), ("f2", 0, None), ("f2", 1, "b")], "f string, pos long, k string")
    assert rows(W.fill_down(df, "k", "pos", "f", 1)) == [("f1", 0, "a"), ("f1", 1, "a"), ("f2", 1, "b")]
    assert W.fill_down(df, "k", "pos", "f", 1, drop_leading=False).count() == 4


def test_block_bounds(make, rows):
    df = make([(0, None), (1, "a"), (2, None), (3, "b"), (4, None)], "pos long, k string")
    assert rows(W.block_bounds(df, "k", "pos"), "k", "min_pos", "max_pos") == [("a", 1, 2), ("b", 3, 4)]


def test_rank_matches_window(spark, make, rows):
    df = make([("g", 1, 5.0), ("g", 2, 9.0), ("g", 3, 5.0), ("g", 4, None), (None, 5, 1.0), ("g", 6, 1.0)], "g string, id int, v double")
    df.createOrReplaceTempView("ranked")
    want = spark.sql("select g, id, v, rank() over (partition by g order by v desc nulls last) as seq from ranked")
    assert rows(W.rank_in_group(df, ["g"], "v"), "g", "id", "seq") == rows(want, "g", "id", "seq")


def test_calendar_is_by_position_not_by_day(make):
    df = make(["2023-01-01", "2023-01-05", "2023-01-05", "2023-01-09", None], "d string").select(F.col("d").cast("date").alias("d"))
    out = {str(r["day"]): str(r["prev_2"]) for r in W.report_calendar(df, "d").collect()}
    assert out == {"2023-01-01": "None", "2023-01-05": "None", "2023-01-09": "2023-01-01"}


def test_first_per_key_and_top_k_ties(make, rows):
    df = make([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], "k int, pos int, v string")
    assert rows(O.first_per_key(df, ["k"], ["pos"]), "k", "v") == [(1, "early"), (2, "only")]
    ties = make([("b", 5), ("a", 5), ("c", 9), ("d", None)], "k string, v int")
    assert [r["k"] for r in O.top_k(ties, 2, ["-v", "k"]).collect()] == ["c", "a"]


def test_grand_total_counts_complete_rows_only(make, rows):
    df = make([("a", 1.0, 2.0), ("a", 3.0, None), ("b", 5.0, 5.0), (None, 7.0, 7.0)], "k string, x double, y double")
    assert rows(S.with_grand_total(df, ["k"], ["x", "y"])) == [("Total", 6.0, 7.0), ("a", 4.0, 2.0), ("b", 5.0, 5.0)]
    whole = S.with_grand_total(df, ["k"], ["x", "y"], complete=F.lit(True))
    assert rows(whole.where("k = 'Total'")) == [("Total", 9.0, 7.0)]


def test_cross_totals(make, rows):
    df = make([("n", "x", 1.0), ("n", "y", 2.0), ("s", "x", 4.0), ("s", "y", None)], "r string, c string, v double")
    assert rows(S.cross_totals(df, "r", "c", ["x", "y"], "v")) == [("Total", 5.0, 2.0, 7.0), ("n", 1.0, 2.0, 3.0), ("s", 4.0, 0.0, 4.0)]


def test_pivot_rules(make, rows):
    df = make([("a", "x", 1.0), ("a", "x", None), ("b", "y", None), (None, "x", 9.0), ("a", None, 9.0)], "k string, c string, val double")
    assert rows(S.pivot_sum(df, ["k"], "c", ["x", "y"])) == [("a", 1.0, None), ("b", None, 0.0)]
    assert rows(S.pivot_mean(df, ["k"], "c", ["x", "y"])) == [("a", 1.0, None)]


def test_pivot_single_refuses_two_rows(make, rows):
    ok = make([("a", "x", 1.0), ("a", "y", 2.0)], "k string, c string, m double")
    assert rows(S.pivot_single(ok, ["k"], "c", ["x", "y"], ["m"])) == [("a", 1.0, 2.0)]
    bad = ok.union(ok)
    with pytest.raises(Exception, match="more than one row"):
        S.pivot_single(bad, ["k"], "c", ["x", "y"], ["m"]).collect()


def test_sets_total_equals_sum_of_parts(make):
    df = make([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "k string, c string, v double")
    out = S.sets_of(df, [["k"], ["c"], []], [total("v").alias("v")], ["k", "c"])
    by = lambda kept: sum(r["v"] for r in out.where(F.col("_gid") == S.gid(["k", "c"], kept)).collect())
    assert by(["k"]) == by(["c"]) == by([]) == 7.0


def test_mean_row_skips_nulls(make, rows):
    df = make([("m1", 1.0, None), ("m2", 3.0, 8.0)], "k string, a double, b double")
    assert ("avg.", 2.0, 8.0) in rows(S.append_mean_row(df, "k", ["a", "b"]))
