"""Who sees what: visibility, masks, row filters and the check of model endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


class EgressViolation(Exception):
    """Controlled text was about to leave for a model that isn't local."""


def visibility(role: Column, controlled: Column) -> Column:
    return F.when(~controlled, "clear").when(role == "compliance", "clear").when(role == "strategy", "summary").when(role == "analyst", "masked").otherwise("hidden")


def masked(role: Column, value: Column, controlled: Column) -> Column:
    """struct(display, masked) of one field."""
    see = visibility(role, controlled)
    display = F.when(see == "clear", value).when(see == "summary", F.concat(F.lit(vocab.SUMMARY_PREFIX), F.substring(value, 1, 8), F.lit(vocab.ELLIPSIS))).when(see == "masked", F.lit(vocab.MASKED))
    return F.struct(display.alias("display"), (see != "clear").alias("masked"))


def row_visible(role: Column, controlled: Column) -> Column:
    return ~controlled | (role != "viewer")


def is_local(url: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a model endpoint's host is a loopback, private or listed one."""
    host = F.lower(F.split(F.split(F.regexp_replace(url, "^https?://", ""), "/").getItem(0), ":").getItem(0))
    second = F.try_element_at(F.split(host, r"\."), F.lit(2)).try_cast("int")
    private = host.startswith("10.") | host.startswith("192.168.") | (host.startswith("172.") & F.coalesce(second.between(16, 31), F.lit(False)))
    return host.isin(*vocab.LOCAL_HOSTS, *[a.strip().lower() for a in allowed if a.strip()]) | private
