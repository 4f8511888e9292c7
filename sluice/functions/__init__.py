"""Scalar functions over unix times, zones, addresses and text."""

from sluice.functions.lookup import ip_number, ip_to_country
from sluice.functions.text import extract_or_null
from sluice.functions.times import parse_instant, register, time_add, time_format, time_range

__all__ = ["extract_or_null", "ip_number", "ip_to_country", "parse_instant", "register", "time_add", "time_format", "time_range"]
