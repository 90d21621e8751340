"""Dates of elections, eras and terms, and small share arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def election_day(year: Column) -> Column:
    """The Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "MON"), 1)


def plan_era(cycle: Column) -> Column:
    """The first cycle of the decade of a districting: 2002, 2012, 2022, ..."""
    return (F.floor((cycle - 2) / 10) * 10 + 2).cast("int")


def senate_class(cycle: Column) -> Column:
    """Class 1, 2 or 3 by the cycle's place in six years."""
    return F.when(cycle % 6 == 2, 1).when(cycle % 6 == 4, 2).when(cycle % 6 == 0, 3)


def midpoint(start: Column, end: Column) -> Column:
    """Middle of a field period as seconds since the epoch."""
    return (F.unix_timestamp(start) + F.unix_timestamp(end)) / 2.0


def margin_from_share(share: Column) -> Column:
    return 2 * share - 1


def share_from_margin(margin: Column) -> Column:
    return (margin + 1) / 2
