"""URL functions as columns."""

from __future__ import annotations

from collections.abc import Iterator
import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import hosts
from .text import decoded  # noqa: F401

#: URLs in normal form already, of the common kind: their hosts end in a name, and none is an encoded one.
PLAIN = r"(?!.*/\.)(?!https?://[^/]*xn--)(?:https?)://(?:[a-z0-9-]+\.)*(?![0-9]+/|0x[0-9a-f]*/)[a-z0-9-]+/[A-Za-z0-9._~!$&()*+,;=:@/-]*(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?"
_PLAIN = re.compile(PLAIN)
_PORTS = {"http": "80", "https": "443"}


def domain_of(host: str) -> str:
    """A domain in its one form, without a dot at its end; an IPv6 address without brackets. ValueError where it is none."""
    host = host.strip().removeprefix("[").removesuffix("]")
    if ":" in host:
        return hosts.ipv6(host)
    return hosts.parsed(host.rstrip("."))


def normal_url(url: str) -> str:
    """An absolute http(s) URL as browsers write it, without its fragment: ports, case, dots and escapes made alike. ValueError for what is none."""
    if _PLAIN.fullmatch(url):
        return url
    url = re.sub("[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    m = re.fullmatch(r"(?i)(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?", url, re.S)
    if not m:
        raise ValueError(url)
    scheme, (login, at, place) = m[1].lower(), m[2].rpartition("@")
    host, bracket, port = place.partition("]") if place.startswith("[") else place.partition(":")
    host, port = hosts.parsed(host + (bracket if bracket == "]" else "")), port.removeprefix(":")
    login = quote(login, "!$&'()*+,%:~")
    if port and not (port.isdigit() and int(port) < 65536):
        raise ValueError(url)
    port = "" if not port or port.lstrip("0") == _PORTS[scheme] else ":" + str(int(port))
    out: list[str] = []
    parts = m[3].replace("\\", "/").split("/")[1:]
    for k, part in enumerate(parts):
        dots = part.lower().replace("%2e", ".")
        if dots in (".", ".."):
            if dots == ".." and out:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(quote(part, "!$&'()*+,;=:@%[]|^~"))
    query = quote(m[4] or "", "!$&()*+,;=:@%[]|^~?/\\`{}")
    return f"{scheme}://{login}{at}{host}{port}/{'/'.join(out)}{query}"


def _or_null(f, x):
    try:
        return None if x is None else f(x)
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def _normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: _or_null(normal_url, x))


def canonical(c: Column) -> Column:
    """An absolute http(s) URL in its normal form, without its fragment; null for what is none. Plain ones, told in the JVM, go to no Python."""
    bare = F.substring_index(c, "#", 1)
    plain = F.regexp_like(bare, F.lit(f"^(?:{PLAIN})$"))
    return F.coalesce(F.when(plain, bare), _normal(F.when(~plain, c)))


@F.pandas_udf(T.StringType())
def normal_domain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A domain in lower case and ASCII, without a dot at its end; null for what is none."""
    for s in batches:
        yield s.map(lambda x: _or_null(domain_of, x))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)), r"\.$", "")


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def https_of(c: Column) -> Column:
    """What an http URL is with https; null for others."""
    return F.when(F.startswith(c, F.lit("http://")), F.concat(F.lit("https://"), F.substr(c, F.lit(8))))


def allowed(host_: Column, domains: Column) -> Column:
    """Whether the host is one of the domains or below one."""
    return F.exists(domains, lambda d: (host_ == d) | F.endswith(host_, F.concat(F.lit("."), d)))


def unsafe(normal: Column, domains: Column) -> Column:
    """Why a URL, in its normal form, isn't fetched, before any name is resolved: scheme, credentials, an address for a host, a host outside the domains; null where nothing is against it."""
    name = host(normal)
    login = F.regexp_like(normal, F.lit("^[a-z]+://[^/?#]*@"))
    number = F.startswith(name, F.lit("[")) | F.regexp_like(name, F.lit(r"^[0-9.]+$"))
    return F.when(normal.isNull(), "scheme").when(login, "credentials").when(number, "address").when(~allowed(name, domains), "domain")


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """The link against its base, http and https only; null where it is no URL."""

    def one(b, x):
        if b is None or x is None:
            return None
        try:
            made = urljoin(b, x.strip())
            parts = urlsplit(made)
            if parts.scheme not in ("http", "https") or not parts.hostname:
                return None
            fragment = made.partition("#")
            return normal_url(made) + fragment[1] + fragment[2]
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


# Networks that must not be fetched from.
BLOCKED_IPV4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
BLOCKED_IPV6 = [("::", 128), ("::1", 128), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8), ("2001:db8::", 32)]


def ipv4_ranges() -> list[tuple[str, int, int]]:
    out = []
    for net, bits in BLOCKED_IPV4:
        a, b, c, d = map(int, net.split("."))
        lo = (a << 24) + (b << 16) + (c << 8) + d
        out.append((f"{net}/{bits}", lo, lo + (1 << (32 - bits)) - 1))
    return out


@F.pandas_udf(T.BooleanType())
def blocked_ipv6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether an address is in a blocked IPv6 network or maps an IPv4 one; null for what is no address."""
    import ipaddress

    nets = [ipaddress.ip_network(f"{n}/{b}") for n, b in BLOCKED_IPV6]

    def one(x):
        try:
            a = ipaddress.IPv6Address(x)
        except ValueError:
            return None
        return a.ipv4_mapped is not None or any(a in n for n in nets)

    for s in batches:
        yield s.map(lambda x: None if x is None else one(x))
