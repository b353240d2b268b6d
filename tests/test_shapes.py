"""Shapes of queries over a small harbour: berths, vessels, and visits of vessels to berths."""

import pytest

from tallyfold import Engine


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("harbour")
    (folder / "berth.csv").write_text(
        "code (T) (P),depth (N),opened (D)\nA1,9.5,1958-04-01 00:00:00\nB2,12.5,1984-09-15 00:00:00\nC3,17,2012-06-30 00:00:00\n"
    )
    (folder / "vessel.csv").write_text(
        "imo (N) (P),title (T),draught (N),flag (T)\n"
        '501,"Gull, the",4.5,NO\n502,Heron,8,NO\n503,Ibis,11.5,PA\n504,Jay,,PA\n505,Kite,15,LR\n'
    )
    (folder / "visit.csv").write_text(
        "nr (N) (P),imo (N),code (T),tonnes (N),arrived (D)\n"
        "1,501,A1,120,1969-12-31 22:00:00\n2,502,B2,900,1999-05-05 06:00:00\n3,503,B2,2400,2003-03-03 03:03:03\n"
        "4,503,C3,2600,2013-07-01 00:00:00\n5,505,C3,7000,2014-01-01 12:00:00\n6,502,A1,,2015-02-02 00:00:00\n7,,C3,-50,\n"
    )
    engine = Engine(spark, str(folder))
    return lambda query: [tuple(r) for r in engine.sql(query).collect()]


def test_a_filter_on_the_other_side_of_a_comma_join(harbour):
    found = harbour("SELECT visit.nr FROM visit, berth WHERE depth >= 17 AND berth.code = visit.code")
    assert sorted(found) == [(4,), (5,), (7,)]


def test_a_spare_depth_computed_over_three_tables(harbour):
    found = harbour(
        "SELECT nr, depth - draught AS spare FROM berth JOIN visit USING (code) JOIN vessel ON vessel.imo = visit.imo "
        "WHERE tonnes IS NOT NULL ORDER BY spare, nr"
    )
    assert found == [(3, 1.0), (5, 2.0), (2, 4.5), (1, 5.0), (4, 5.5)]


def test_rows_above_a_scaled_aggregate_of_another_table(harbour):
    assert harbour("SELECT nr FROM visit WHERE tonnes > 100 * (SELECT MAX(depth) FROM berth) ORDER BY tonnes DESC") == [(5,), (4,), (3,)]


def test_rows_below_the_mean_of_their_own_group(harbour):
    found = harbour(
        "SELECT v.nr FROM visit AS v WHERE v.tonnes < (SELECT AVG(w.tonnes) FROM visit AS w WHERE w.code = v.code) ORDER BY v.nr"
    )
    assert found == [(2,), (4,), (7,)]


def test_dates_and_ranges_in_either_branch(harbour):
    found = harbour(
        "SELECT nr FROM visit WHERE arrived < TIMESTAMP_NTZ'1970-01-01 00:00:00' OR (nr BETWEEN 3 AND 5 AND NOT tonnes < 2500) ORDER BY nr DESC"
    )
    assert found == [(5,), (4,), (1,)]


def test_a_count_for_each_row_of_an_outer_table(harbour):
    found = harbour("SELECT title, (SELECT COUNT(*) FROM visit WHERE visit.imo = vessel.imo) AS calls FROM vessel ORDER BY calls DESC, title")
    assert found == [("Heron", 2), ("Ibis", 2), ("Gull, the", 1), ("Kite", 1), ("Jay", 0)]


def test_aggregates_of_a_filtered_join(harbour):
    found = harbour("SELECT COUNT(*), COUNT(tonnes), SUM(tonnes), MIN(arrived) FROM visit JOIN vessel ON visit.imo = vessel.imo WHERE flag = 'NO'")
    assert [(n, k, t, d.year) for n, k, t, d in found] == [(3, 2, 1020, 1969)]


def test_groups_windows_and_sets(harbour):
    assert harbour("SELECT flag, COUNT(*) AS n FROM vessel GROUP BY flag HAVING COUNT(*) > 1 ORDER BY flag") == [("NO", 2), ("PA", 2)]
    found = harbour("SELECT nr, row_number() OVER (PARTITION BY code ORDER BY tonnes DESC NULLS LAST) AS place FROM visit")
    assert sorted(n for n, place in found if place == 1) == [1, 3, 5]
    assert harbour("SELECT imo FROM vessel EXCEPT SELECT imo FROM visit") == [(504,)]


def test_vessels_that_never_called_and_visits_of_no_vessel(harbour):
    assert harbour("SELECT title, nr FROM vessel FULL JOIN visit ON vessel.imo = visit.imo WHERE nr IS NULL OR title IS NULL ORDER BY nr NULLS FIRST") == [
        ("Jay", None), (None, 7),
    ]


def test_pairs_of_a_large_group_are_made_by_many_tasks(spark, monkeypatch):
    """A key that most rows have is cut into chunks; nulls pair with nothing, repeated ids with each other."""
    from tallyfold.operators import equal_pairs, join

    monkeypatch.setattr(join, "CHUNK", 50)
    monkeypatch.setattr(join, "TASK_PAIRS", 2000)
    groups = [(k, ("x" if k % 10 else None), k // 300) for k in [*range(330), 7]]
    found = equal_pairs(spark.createDataFrame(groups, "k long, t string, n int"), "k", "t", "n")
    expected = sorted((a, b) for a, t, n in groups for b, u, m in groups if t and (t, n) == (u, m))
    assert sorted(map(tuple, found.collect())) == expected
    each = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(each) >= 30 and max(each) < len(expected) / 2
