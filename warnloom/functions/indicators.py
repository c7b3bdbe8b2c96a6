"""Indicator-of-compromise extraction as column expressions on normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scans
from .core import WS, find_all
from .lexicons import DOMAIN_TLDS, IOC_LABELS

_TLD = "(?:" + "|".join(DOMAIN_TLDS) + ")"

# The shape of each indicator. (?U) makes \b and \d Unicode-aware on every JDK.
CVE = r"(?iU)(?=[cC])\bCVE-\d{4}-\d{4,7}\b"
IPV4 = r"(?U)(?=\d)\b(?:\d{1,3}\.){3}\d{1,3}\b"
URL = rf"""(?iU)\bhttps?://[^{WS})"'<>]+"""
HASH = r"(?U)\b[a-fA-F0-9]{32,64}\b"
# Characters that a CVE and the boundary after it take at most behind "cve-".
CVE_TAIL = 16
HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}
# Fixed value: characters that do not end a URL.
URL_TAIL = ".,;:!?)\\]\"'"

# E-mail addresses and domains. The plain patterns, \b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b
# and \b(?:[A-Za-z0-9-]+\.)+TLD\b, restart at every label of a long dotted run (quadratic) and the
# second recurses once per label, which overflows the stack on a few thousand labels. A match can
# only start at the first boundary of a run, or where the previous match ended, so these try just
# that one start: the same matches in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = (
    rf"(?U)(?:(?<!{_LOCAL})|\G)(?>{_LOCAL}*?\b(?={_LOCAL}))"
    rf"({_LOCAL}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}+\b)"
)
_LABEL = "[A-Za-z0-9-]"
_DOTTED = "[A-Za-z0-9.-]"
DOMAIN = rf"(?iU)(?<!{_DOTTED})(?>{_DOTTED}*?\b(?={_LABEL}))({_LABEL}{_DOTTED}*\.{_TLD}\b)"
# What a text must hold for DOMAIN to match at all; most prose does not.
DOMAIN_ENDING = rf"(?iU)\.{_TLD}\b"


def _none() -> Column:
    return F.array().cast("array<string>")


def _search(parts: Column, pattern: str) -> Column:
    """All matches in the parts of a text that a scan has left; null for null."""
    return F.when(parts == "", _none()).otherwise(find_all(parts, pattern))


def cves(text: Column) -> Column:
    return _search(scans.near(text, ["cve-"], CVE_TAIL), CVE)


def ipv4(text: Column) -> Column:
    return F.when(scans.may_hold_address(text), find_all(text, IPV4)).otherwise(_none())


def urls(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("://")), find_all(text, URL)).otherwise(_none())


def emails(text: Column) -> Column:
    parts = scans.runs(text, "@")
    return F.when(parts != "", find_all(parts, EMAIL, 1)).otherwise(_none())


def hashes(text: Column) -> Column:
    """All hex runs of 32 to 64 digits; the three hash kinds are told apart by length."""
    return _search(scans.runs(text, "", min(HASH_LENGTHS.values())), HASH)


def hashes_sql(runs: str, label: str) -> str:
    """The hashes of one kind among hex runs, as a SQL expression."""
    return f"filter({runs}, h -> length(h) = {HASH_LENGTHS[label]})"


def domains(text: Column) -> Column:
    # An empty label never matches, so a space between two adjacent dots changes no match and lets
    # one character class stand for a whole run.
    dotted = scans.runs(text, ".")
    split_dots = F.regexp_replace(dotted, r"\.(?=\.)", ". ")
    return F.when(dotted.rlike(DOMAIN_ENDING), find_all(split_dots, DOMAIN, 1)).otherwise(_none())


def find_label(text: Column, label: str) -> Column:
    """Every match of one label in text order, repeats included."""
    if label in HASH_LENGTHS:
        return F.filter(hashes(text), lambda h: F.length(h) == HASH_LENGTHS[label])
    return {"cves": cves, "ipv4": ipv4, "urls": urls, "emails": emails, "domains": domains}[label](
        text
    )


def trim_url_tail(values: Column) -> Column:
    return F.transform(values, lambda u: F.rtrim(u, F.lit(URL_TAIL)))


def drop_embedded_domains(domain_values: Column, url_values: Column, email_values: Column) -> Column:
    """Drop domains that occur inside a URL or an e-mail address of the same report."""
    container = F.lower(F.array_join(F.concat(url_values, email_values), " "))
    return F.when(F.size(domain_values) == 0, domain_values).otherwise(
        F.get(
            F.transform(
                F.array(container),
                lambda c: F.filter(domain_values, lambda d: ~F.contains(c, F.lower(d))),
            ),
            F.lit(0),
        )
    )


def ioc_total(iocs: Column) -> Column:
    """Indicators over all eight labels."""
    return sum((F.size(iocs[label]) for label in IOC_LABELS[1:]), F.size(iocs[IOC_LABELS[0]]))
