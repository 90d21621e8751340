"""States by name, postal code or FIPS code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Postal code, FIPS code and name of the states, the District of Columbia and Puerto Rico.
STATES = """\
AL 01 Alabama
AK 02 Alaska
AZ 04 Arizona
AR 05 Arkansas
CA 06 California
CO 08 Colorado
CT 09 Connecticut
DE 10 Delaware
DC 11 District of Columbia
FL 12 Florida
GA 13 Georgia
HI 15 Hawaii
ID 16 Idaho
IL 17 Illinois
IN 18 Indiana
IA 19 Iowa
KS 20 Kansas
KY 21 Kentucky
LA 22 Louisiana
ME 23 Maine
MD 24 Maryland
MA 25 Massachusetts
MI 26 Michigan
MN 27 Minnesota
MS 28 Mississippi
MO 29 Missouri
MT 30 Montana
NE 31 Nebraska
NV 32 Nevada
NH 33 New Hampshire
NJ 34 New Jersey
NM 35 New Mexico
NY 36 New York
NC 37 North Carolina
ND 38 North Dakota
OH 39 Ohio
OK 40 Oklahoma
OR 41 Oregon
PA 42 Pennsylvania
RI 44 Rhode Island
SC 45 South Carolina
SD 46 South Dakota
TN 47 Tennessee
TX 48 Texas
UT 49 Utah
VT 50 Vermont
VA 51 Virginia
WA 53 Washington
WV 54 West Virginia
WI 55 Wisconsin
WY 56 Wyoming
PR 72 Puerto Rico"""
ROWS = [line.split(" ", 2) for line in STATES.splitlines()]


def postal(x: Column) -> Column:
    """The postal code of a state given by postal code, FIPS code (one or two digits) or name; null for anything else."""
    known = {key: code for code, fips, name in ROWS for key in (code, fips, name.upper())}
    value = F.upper(F.trim(x.cast("string")))
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in known.items() for v in pair]), F.when(F.length(value) == 1, F.lpad(value, 2, "0")).otherwise(value))


def fips(x: Column) -> Column:
    """The FIPS code of a state given in any of these ways."""
    return F.try_element_at(F.create_map(*[F.lit(v) for code, number, _ in ROWS for v in (code, number)]), postal(x))
