"""Page addresses: normal forms and keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("exact", "query-sorted", "ignore-arguments")


def _parts(url: Column) -> tuple[Column, Column, Column]:
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(.*)$", 1)
    return head, query, fragment


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    """Form encoding; the two characters on which encoders differ are settled here."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _arguments(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(p.contains("="), _decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v"),
        ),
    )


def normalise_url(url: Column, strategy: str | Callable[[Column], Column] = "exact") -> Column:
    """One spelling for equivalent addresses.

    ``query-sorted`` orders the arguments, ``ignore-arguments`` drops the one named ARGUMENTS; a
    callable is applied as it is.
    """
    if callable(strategy):
        return strategy(url)
    if strategy == "exact":
        return url
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown key strategy {strategy!r}, choose from {STRATEGIES}")
    head, query, fragment = _parts(url)
    arguments = _arguments(query)
    if strategy == "query-sorted":
        arguments = F.array_sort(arguments)
    else:
        arguments = F.filter(arguments, lambda a: F.upper(a["k"]) != "ARGUMENTS")
    text = F.array_join(F.transform(arguments, lambda a: F.concat(_encode(a["k"]), F.lit("="), _encode(a["v"]))), "&")
    return F.concat(
        head,
        F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def page_key(url: Column, strategy: str | Callable[[Column], Column] = "exact") -> Column:
    return F.sha1(normalise_url(url, strategy))


def page_kind(url: Column) -> Column:
    """Value of the PRGNAME argument, NULL without one."""
    kind = F.regexp_extract(url, r"[?&]PRGNAME=([^&#]*)", 1)
    return F.when(kind != "", kind)
