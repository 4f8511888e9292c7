from datetime import date, datetime, timezone

from hypothesis import given
from hypothesis import strategies as st

from sluice.plans import schedule as S

AT = datetime(2024, 2, 29, 13, 14, 15)


def test_units_begin_and_end():
    assert S.start_of(AT, S.Unit.WEEK) == datetime(2024, 2, 26) and S.end_of(AT, S.Unit.WEEK) == datetime(2024, 3, 4)
    assert S.end_of(AT, S.Unit.MONTH) == datetime(2024, 3, 1) and S.end_of(AT, S.Unit.YEAR) == datetime(2025, 1, 1)
    assert S.start_of(AT, S.Unit.HOUR) == datetime(2024, 2, 29, 13) and S.end_of(AT, S.Unit.HOUR) == datetime(2024, 2, 29, 14)


@given(st.datetimes(datetime(1980, 1, 1), datetime(2080, 1, 1)), st.sampled_from(list(S.Unit)))
def test_a_moment_is_within_its_unit(at, unit):
    assert S.start_of(at, unit) <= at < S.end_of(at, unit)


def test_repeats():
    days = list(S.every_week(3).times(datetime(2024, 1, 1), datetime(2024, 3, 1)))
    assert days == [datetime(2024, 1, 1), datetime(2024, 1, 22), datetime(2024, 2, 12)]
    ends = list(S.EVERY_MONTH.times(datetime(2024, 1, 31), datetime(2024, 4, 1)))
    assert ends == [datetime(2024, 1, 31), datetime(2024, 2, 29), datetime(2024, 3, 31)]
    assert [d.day for d in S.EVERY_WORKDAY.times(datetime(2024, 1, 5), datetime(2024, 1, 10))] == [5, 8, 9]
    assert [d.day for d in S.every(S.Weekday.SUNDAY).times(datetime(2024, 1, 1), datetime(2024, 1, 15))] == [7, 14]
    both = (S.EVERY_WEEK + S.every(S.Weekday.TUESDAY)) + datetime(2024, 1, 3, 5)
    assert [d.day for d in both.times(datetime(2024, 1, 1), datetime(2024, 1, 9))] == [1, 2, 3, 8]


def test_scheduled_time_moves_both_ways():
    t = S.SCHEDULED_TIME + S.days(1) - S.hours(2)
    assert t.resolve(datetime(2024, 1, 1)) == datetime(2024, 1, 1, 22)
    assert (S.SCHEDULED_TIME - S.months(1)).truncated(S.Unit.MONTH).resolve(AT) == datetime(2024, 1, 1)
    assert S.SCHEDULED_TIME.unix_time(datetime(1970, 1, 2)) == 86400 and t({"scheduled": datetime(2024, 1, 1)}) == datetime(2024, 1, 1, 22)


def test_clock():
    c = S.Clock(fixed=AT)
    day = lambda d: datetime(2024, *d, tzinfo=c.now().tzinfo)
    assert c.today() == day((2, 29)) and c.yesterday() == day((2, 28)) and c.tomorrow() == c.midnight() == day((3, 1)) and c.evening() == day((2, 29, 18))
    assert c.whole(S.Unit.MONTH, -1) == (day((1, 1)), day((2, 1))) and c.whole(S.Unit.WEEK, 1) == (day((3, 4)), day((3, 11)))
    assert c.last(S.days(7))[0] == day((2, 22, 13, 14, 15)) and c.until(day((5, 1))) == (c.now(), day((5, 1)))
    assert S.Clock("Asia/Tokyo", datetime(2024, 1, 1, 20, tzinfo=timezone.utc)).now().tzinfo is timezone.utc


def test_config_bounds_and_excluded_days():
    c = S.TaskConfig(S.EVERY_DAY, exclude=frozenset({date(2024, 1, 2)}), start_at=datetime(2024, 1, 1), end_at=datetime(2024, 1, 4))
    assert [t.day for t in c.times(datetime(2023, 12, 30), datetime(2025, 1, 1))] == [1, 3]
    assert S.TaskConfig().retry == 3 and S.TaskConfig().times(AT, S.end_of(AT, S.Unit.DAY)) == [AT]
