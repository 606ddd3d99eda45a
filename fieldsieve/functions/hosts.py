"""Hosts of URLs as browsers read them: names by UTS 46 without transition, numbers as IPv4 addresses, IPv6 in its short form."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

# Characters that no host has, letters that stay though folding would change them, what is left out, and stops of other scripts.
FORBIDDEN = re.compile("[\x00-\x20\"#%/:<>?@\\[\\\\\\]^`{|}\x7f]")
KEPT = "ßς‌‍"
IGNORED = re.compile("[­͏᠋-᠍᠏​⁠⁤︀-️﻿\U000e0100-\U000e01ef]")
STOPS = re.compile("[。．｡]")

#: Categories whose characters aren't in a name after mapping: controls, spaces, surrogates, unassigned, private.
_REFUSED = {"Cc", "Zs", "Zl", "Zp", "Cs", "Cn", "Co"}
_NUMBER = re.compile("(?:0x[0-9a-f]*|[0-9]+)", re.I)


def _mapped(name: str) -> str:
    """Compatibility forms and capitals folded; the letters of KEPT stay, a capital sharp s is a small one."""
    out = "".join(c if c in KEPT else "ß" if c == "ẞ" else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in IGNORED.sub("", STOPS.sub(".", name)))
    return unicodedata.normalize("NFC", out)


def _valid(label: str) -> bool:
    return unicodedata.normalize("NFC", label) == label and unicodedata.category(label[0])[0] != "M" and not any(unicodedata.category(c) in _REFUSED or c in IGNORED.pattern and IGNORED.match(c) for c in label)


def _label(label: str) -> str:
    """A mapped label in ASCII; one that is so written already has to be the one spelling of a valid name."""
    if label.startswith("xn--"):
        try:
            plain = label[4:].encode().decode("punycode")
        except (UnicodeError, ValueError):
            raise ValueError(label) from None
        if not plain or plain.isascii() or _mapped(plain) != plain or not _valid(plain) or "xn--" + plain.encode("punycode").decode() != label:
            raise ValueError(label)
        return label
    if label.isascii():
        return label
    if not _valid(label):
        raise ValueError(label)
    return "xn--" + label.encode("punycode").decode()


def _part(text: str) -> int:
    """A number in base 16, 8 or 10; `0x` alone is nought."""
    if text[:2].lower() == "0x":
        return int(text[2:] or "0", 16)
    return int(text, 8 if len(text) > 1 and text[0] == "0" else 10)


def ends_in_number(host: str) -> bool:
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    return _NUMBER.fullmatch(parts[-1]) is not None


def ipv4(host: str) -> str:
    """Up to four numbers; the last fills what is left. ValueError where one is none, or too large."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if len(parts) > 4 or not all(_NUMBER.fullmatch(p) for p in parts):
        raise ValueError(host)
    *head, last = map(_part, parts)
    if any(n > 255 for n in head) or last >= 256 ** (5 - len(parts)):
        raise ValueError(host)
    number = last + sum(n << 8 * (3 - k) for k, n in enumerate(head))
    return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))


def ipv6(text: str) -> str:
    """The short form, pieces in hexadecimal, the first of the longest runs of two noughts or more left out. ValueError for what is no address."""
    import ipaddress

    if "%" in text:
        raise ValueError(text)
    number = int(ipaddress.IPv6Address(text))
    pieces = [f"{number >> s & 0xFFFF:x}" for s in range(112, -1, -16)]
    runs = [(m.end() - m.start(), -m.start()) for m in re.finditer("0{2,}", "".join("0" if p == "0" else "x" for p in pieces))]
    if not runs:
        return ":".join(pieces)
    n, at = max(runs)
    return ":".join(pieces[:-at]) + "::" + ":".join(pieces[-at + n :])


def parsed(host: str) -> str:
    """A host in the one form that browsers give it; ValueError where it is none. Brackets of an IPv6 address stay."""
    if host.startswith("["):
        if not host.endswith("]"):
            raise ValueError(host)
        return f"[{ipv6(host[1:-1])}]"
    if "%" in host:
        host = unquote_to_bytes(host.encode("utf-8", "surrogatepass")).decode("utf-8")
    if not host.isascii() or "xn--" in host.lower():
        host = ".".join(_label(x) if x else x for x in _mapped(host).split("."))
    host = host.lower()
    if not host or FORBIDDEN.search(host) or not host.isascii():
        raise ValueError(host)
    return ipv4(host) if ends_in_number(host) else host
