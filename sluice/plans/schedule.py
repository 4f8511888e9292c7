"""Calendar units, repeats, scheduled times and date ranges, on an injected clock."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import date, datetime, time, timedelta
from enum import Enum, IntEnum
from zoneinfo import ZoneInfo

from dateutil.relativedelta import relativedelta


class Unit(Enum):
    SECOND, MINUTE, HOUR, DAY, WEEK, MONTH, YEAR = "seconds", "minutes", "hours", "days", "weeks", "months", "years"


class Weekday(IntEnum):
    MONDAY, TUESDAY, WEDNESDAY, THURSDAY, FRIDAY, SATURDAY, SUNDAY = range(7)


Month = IntEnum("Month", "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER")
WORKDAYS = frozenset(list(Weekday)[:5])


@dataclass(frozen=True)
class Duration:
    """A signed number of units; months and years follow the calendar."""

    n: int
    unit: Unit

    def delta(self) -> relativedelta:
        return relativedelta(**{self.unit.value: self.n})

    def __neg__(self) -> Duration:
        return Duration(-self.n, self.unit)


def seconds(n: int) -> Duration:
    return Duration(n, Unit.SECOND)


def minutes(n: int) -> Duration:
    return Duration(n, Unit.MINUTE)


def hours(n: int) -> Duration:
    return Duration(n, Unit.HOUR)


def days(n: int) -> Duration:
    return Duration(n, Unit.DAY)


def weeks(n: int) -> Duration:
    return Duration(n, Unit.WEEK)


def months(n: int) -> Duration:
    return Duration(n, Unit.MONTH)


def start_of(at: datetime, unit: Unit) -> datetime:
    """The beginning of the unit that holds `at`; weeks begin on Monday."""
    kept = {Unit.SECOND: 6, Unit.MINUTE: 5, Unit.HOUR: 4, Unit.DAY: 3, Unit.WEEK: 3, Unit.MONTH: 2, Unit.YEAR: 1}[unit]
    parts = [at.year, at.month, at.day, at.hour, at.minute, at.second]
    begun = datetime(*(p if k < kept else d for k, (p, d) in enumerate(zip(parts, [1, 1, 1, 0, 0, 0]))), tzinfo=at.tzinfo)
    return begun - timedelta(days=begun.weekday()) if unit is Unit.WEEK else begun


def end_of(at: datetime, unit: Unit) -> datetime:
    """The first moment after the unit that holds `at`."""
    return start_of(at, unit) + Duration(1, unit).delta()


@dataclass(frozen=True)
class Repeat:
    """Every n units, or every day of a set of weekdays."""

    n: int = 1
    unit: Unit = Unit.DAY
    on: frozenset[Weekday] = frozenset()

    def times(self, start: datetime, end: datetime | None = None) -> Iterator[datetime]:
        """start and what follows it, up to but not including end. Months are counted from the start, so that ends of months don't drift."""
        k = 0
        while True:
            at = start + Duration(k * self.n, self.unit).delta()
            if end is not None and at >= end:
                return
            if not self.on or at.weekday() in self.on:
                yield at
            k += 1

    def __add__(self, other: Repeat) -> Schedule:
        return Schedule((self, other))


@dataclass(frozen=True)
class Schedule:
    """Several repeats and fixed times together."""

    parts: tuple[Repeat | datetime, ...]

    def __add__(self, other: Repeat | datetime) -> Schedule:
        return Schedule((*self.parts, other))

    def times(self, start: datetime, end: datetime) -> list[datetime]:
        """All times in [start, end), each once, in order."""
        found = {t for p in self.parts for t in (p.times(start, end) if isinstance(p, Repeat) else [p]) if start <= t < end}
        return sorted(found)


def every(*on: Weekday) -> Repeat:
    return Repeat(on=frozenset(on))


EVERY_HOUR, EVERY_DAY, EVERY_WEEK = Repeat(1, Unit.HOUR), Repeat(1, Unit.DAY), Repeat(1, Unit.WEEK)
EVERY_MONTH, EVERY_YEAR, EVERY_WORKDAY = Repeat(1, Unit.MONTH), Repeat(1, Unit.YEAR), Repeat(on=WORKDAYS)


def every_week(n: int) -> Repeat:
    return Repeat(n, Unit.WEEK)


@dataclass(frozen=True)
class Clock:
    """Now, in a zone; tests and reruns give a fixed now."""

    zone: str = "UTC"
    fixed: datetime | None = None

    def now(self) -> datetime:
        at = self.fixed or datetime.now(ZoneInfo(self.zone))
        return at if at.tzinfo else at.replace(tzinfo=ZoneInfo(self.zone))

    def today(self) -> datetime:
        """Midnight at the beginning of the day."""
        return start_of(self.now(), Unit.DAY)

    def yesterday(self) -> datetime:
        return self.today() - timedelta(days=1)

    def tomorrow(self) -> datetime:
        return self.today() + timedelta(days=1)

    midnight = tomorrow

    def evening(self, hour: int = 18) -> datetime:
        return datetime.combine(self.today(), time(hour), self.today().tzinfo)

    def last(self, d: Duration) -> tuple[datetime, datetime]:
        """The range of a duration that ends now."""
        return self.now() - d.delta(), self.now()

    def until(self, end: datetime) -> tuple[datetime, datetime]:
        return self.now(), end

    def whole(self, unit: Unit, offset: int = 0) -> tuple[datetime, datetime]:
        """The unit that holds now, moved by a number of units: -1 is the last one, 1 the next."""
        begin = start_of(self.now(), unit) + Duration(offset, unit).delta()
        return begin, begin + Duration(1, unit).delta()


@dataclass(frozen=True)
class ScheduledTime:
    """The time for which a run is scheduled, moved by durations; known once a run resolves it."""

    moves: tuple[Duration, ...] = ()
    unit: Unit | None = None

    def __add__(self, d: Duration) -> ScheduledTime:
        return replace(self, moves=(*self.moves, d))

    def __sub__(self, d: Duration) -> ScheduledTime:
        return self + -d

    def truncated(self, unit: Unit) -> ScheduledTime:
        return replace(self, unit=unit)

    def resolve(self, scheduled: datetime) -> datetime:
        at = start_of(scheduled, self.unit) if self.unit else scheduled
        for d in self.moves:
            at += d.delta()
        return at

    def unix_time(self, scheduled: datetime) -> int:
        at = self.resolve(scheduled)
        return int((at if at.tzinfo else at.replace(tzinfo=ZoneInfo("UTC"))).timestamp())

    def __call__(self, params) -> datetime:
        """As a query's argument: a zone-free moment, from the run's parameter `scheduled`."""
        return self.resolve(params["scheduled"]).replace(tzinfo=None)


SCHEDULED_TIME = ScheduledTime()


@dataclass(frozen=True)
class TaskConfig:
    """When and how often a task runs: its repeat, days left out, bounds, a deadline, and tries after a failure."""

    repeat: Repeat | Schedule | None = None
    exclude: frozenset[date] = field(default_factory=frozenset)
    start_at: datetime | None = None
    end_at: datetime | None = None
    deadline: Duration | None = None
    retry: int = 3

    def times(self, start: datetime, end: datetime) -> list[datetime]:
        """The scheduled times in [start, end)."""
        start, end = max(start, self.start_at or start), min(end, self.end_at or end)
        found = [start] if self.repeat is None else self.repeat.times(start, end)
        return [t for t in found if start <= t < end and t.date() not in self.exclude]
