"""PII: detected entities are replaced by keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the values of an entity's shape (a Feistel network over the positions' alphabets,
after format-preserving encryption): letters stay letters of their script and case, digits digits, and what the type
prescribes stays (a country code, an exchange of 555, valid check digits, octets below 256, a domain of the
reserved kind). A permutation has no collisions and this one no fixed points, so different entities keep different
surrogates and one entity has the same everywhere, without a table of entities. Names are spelt in syllables of their
script; a surname has one form whatever the honorific, a given name an ending of the gender that honorifics in the text
tell. Other mentions of a name's words in the same text are replaced as well, in capitals too. Case doesn't tell addresses
apart, nor the script of digits cards, accounts and phones. One pass makes the surrogates and stores what stands for what;
where two entities of a corpus share a surrogate all the same, theirs are made anew under keys of their own (`distinct`).
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .lineage import cut, unused
from .words import new_lengths, row_slices

KEY = b"fieldsieve surrogates"
ROUNDS = 8

_HEX, _DIGITS = "0123456789abcdef", "0123456789"

PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "key": r"(?<![\w-])(?P<prefix>AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza)(?P<key>[A-Za-z0-9_-]{16,})(?!\w)",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\b\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_-]{8,})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.])(?:\d{16}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|3[47]\d{13}|3[47]\d{2}([ -])\d{6}\2\d{5})(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?<=[\d .-])\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?<=\+)\d{8,15}|0\d{1,4}[ /-]\d{5,8})(?!\w|\.\d)",
    "hex": r"(?<!\w)(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,64}(?!\w)",
    "name": r"\b(?P<honorific>Mr|Mister|Mrs|Ms|Miss|Madam|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr)\b(?P<gap>\.? +)(?P<name>(?:[^\W\d_a-z]\. ?){0,3}(?:(?:van|von|der|den|de|del|della|di|da|du|la|le|ten|ter|zu|bin|ibn) ){0,3}[^\W\d_a-z](?:\w|['’](?=[^\W\d_a-z]))+(?:[ -][^\W\d_a-z](?:\w|['’](?=[^\W\d_a-z]))+)?)",
}
_EACH = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Every entity but a name or a key holds one of these; a name begins with a honorific.
_MARK, _ASCII_MARK = re.compile(r"[\d@=:]+"), re.compile("[0-9@=:]+")
_HONORIFIC = [f"{x}{y}" for x in "Mr Mister Mrs Ms Miss Madam Dr Prof Herr Frau Monsieur Madame Mme Señora Señor Sra Sr".split() for y in " ."]
#: Keys may hold no mark.
_PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza"]
_REACH = 80
_MALE, _FEMALE = {"mr", "mister", "herr", "monsieur", "señor", "sr"}, {"mrs", "ms", "miss", "madam", "frau", "madame", "mme", "señora", "sra"}
#: Onsets, vowels and endings of surrogate names by script.
_SOUNDS = {
    "LATIN": ("bcdfghjklmnprstvwz", "aeiou", {"m": "nr", "f": "ae"}),
    "CYRILLIC": ("бвгджзклмнпрстхш", "аеиоу", {"m": "нр", "f": "ая"}),
    "GREEK": ("βγδζθκλμνπρστφχ", "αεηιο", {"m": "νσ", "f": "αη"}),
}


_RESERVED = re.compile(r"(?:^|\.)example\.(?:com|org|net)$")
#: Hexadecimal numbers of one case with a letter at least.
_HEXES = re.compile("(?=[0-9]*[a-f])[0-9a-f]+|(?=[0-9]*[A-F])[0-9A-F]+")


@dataclass(frozen=True)
class Entity:
    kind: str
    begin: int
    end: int
    value: str
    gender: str = ""


def _places(text: str) -> list[tuple[int, int]]:
    """Parts of the text where an entity can be: _REACH characters around each mark or honorific, up to white space."""
    at = [m.span() for m in (_ASCII_MARK if text.isascii() else _MARK).finditer(text)]
    for h in (*_HONORIFIC, *_PREFIXES):
        k = text.find(h)
        while k >= 0:
            at.append((k, k + len(h)))
            k = text.find(h, k + 1)
    if not at:
        return []
    at.sort()
    out: list[list[int]] = []
    for a, b in at:
        a, b = max(0, a - _REACH), min(len(text), b + _REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    wide = []
    for a, b in out:
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if wide and a <= wide[-1][1]:
            wide[-1] = (wide[-1][0], b)
        else:
            wide.append((a, b))
    return wide


def find(text: str) -> list[Entity]:
    """Entities in order, without overlaps: an earlier begin goes first, then the order of PATTERNS."""
    found = []
    for a, b in _places(text):
        for rank, (kind, pattern) in enumerate(_EACH.items()):
            if kind == "email" and text.find("@", a, b) < 0:
                continue
            for m in pattern.finditer(text, a, b):
                group, gender = {"secret": "secret", "key": "key", "name": "name"}.get(kind, 0), ""
                if kind == "ip6" and not _is_ip6(m[0]):
                    continue
                if kind == "name":
                    h = m["honorific"].lower()
                    gender = "m" if h in _MALE else "f" if h in _FEMALE else ""
                found.append((m.start(group), rank, Entity(kind, m.start(group), m.end(group), m[group], gender)))
    found.sort(key=lambda x: x[:2])
    out, at = [], 0
    for _, _, e in found:
        if e.begin >= at:
            out.append(e)
            at = e.end
    return out


def _is_ip6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
        return True
    except ValueError:
        return False


def _number(key: bytes, parts: tuple[str, ...], least: int = 1) -> int:
    """A keyed number far above `least`, so that its remainders are even."""
    message, raw = "\x1f".join(parts).encode(), b""
    while len(raw) * 8 < least.bit_length() + 64:
        raw += hmac.new(key, len(raw).to_bytes(4, "big") + message, hashlib.sha512).digest()
    return int.from_bytes(raw, "big")


def permuted(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """A keyed permutation of mixed-radix numbers: to each half in turn a keyed number made from the other is added, place by place."""
    n = len(digits)
    if n < 2:
        return [(d + _number(key, (tweak, "one"))) % r for d, r in zip(digits, radices)]
    half = n // 2
    spans = (range(half), range(half, n))
    for r in range(ROUNDS):
        to, by = spans[r % 2], spans[1 - r % 2]
        add = _number(key, (tweak, str(r), ",".join(str(digits[k]) for k in by)), math.prod(radices[k] for k in to))
        for k in to:
            add, step = divmod(add, radices[k])
            digits[k] = (digits[k] + step) % radices[k]
    return digits


def _restored(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """The inverse of `permuted` for two digits or more."""
    half = len(digits) // 2
    spans = (range(half), range(half, len(digits)))
    for r in reversed(range(ROUNDS)):
        to, by = spans[r % 2], spans[1 - r % 2]
        add = _number(key, (tweak, str(r), ",".join(str(digits[k]) for k in by)), math.prod(radices[k] for k in to))
        for k in to:
            add, step = divmod(add, radices[k])
            digits[k] = (digits[k] - step) % radices[k]
    return digits


def moved(key: bytes, tweak: str, digits: list[int], radices: list[int], kept: Callable[[list[int]], bool] | None = None) -> list[int]:
    """A keyed permutation in a single cycle, hence without fixed points: the number is permuted, one is added, and it is permuted back.

    With `kept` the cycle is followed to the next number that it holds for; numbers that it holds for are permuted among themselves.
    """
    n = len(digits)
    if not n:
        return digits
    order = sorted(range(radices[0]), key=lambda k: _number(key, (tweak, "one", str(k)))) if n == 1 else []
    at = [order.index(digits[0])] if n == 1 else permuted(key, tweak, list(digits), radices)
    while True:
        for k in range(n):
            at[k] = (at[k] + 1) % radices[k]
            if at[k]:
                break
        new = [order[at[0]]] if n == 1 else _restored(key, tweak, list(at), radices)
        if kept is None or new == digits or kept(new):
            return new


#: Letters that are common in names and addresses, by script and case, without the final sigma.
_LETTERS = [
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(k) for k in range(0xDF, 0x100) if k != 0xF7), "".join(chr(k) for k in range(0xC0, 0xDF) if k != 0xD7),
    "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(chr(k) for k in range(0x3B1, 0x3CA) if k != 0x3C2), "".join(chr(k) for k in range(0x391, 0x3AA) if k != 0x3A2),
]
_COMMON = {c: letters for letters in _LETTERS for c in letters}


@functools.cache
def _alphabet(c: str) -> str:
    """What a character is permuted among: digits, common letters of its script and case, or letters of its kind and script near it; itself, if it is none of these."""
    if c in _COMMON:
        return _COMMON[c]
    kind, script = unicodedata.category(c), lambda x: unicodedata.name(x, "").split(" ")[0]
    if kind == "Nd":
        zero = ord(c) - unicodedata.digit(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if kind not in ("Ll", "Lu", "Lo"):
        return c
    begin = ord(c) & ~0x3F
    return "".join(x for x in map(chr, range(begin, begin + 64)) if x not in _COMMON and unicodedata.category(x) == kind and script(x) == script(c))


def same_shape(key: bytes, tweak: str, value: str, alphabet=_alphabet, kept: Callable[[str], bool] | None = None) -> str:
    """The permutation over values of the same shape, or of those among them that `kept` holds for; characters without an alphabet of their own stay."""
    sets = [alphabet(c) for c in value]
    at = [k for k, s in enumerate(sets) if len(s) > 1]
    shape = "".join(c if len(s) == 1 else s[0] for c, s in zip(value, sets))

    def spelt(digits: list[int]) -> str:
        out = list(value)
        for k, d in zip(at, digits):
            out[k] = sets[k][d]
        return "".join(out)

    return spelt(moved(key, f"{tweak}\x1e{shape}", [sets[k].index(value[k]) for k in at], [len(sets[k]) for k in at], kept and (lambda digits: kept(spelt(digits)))))


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _word_name(key: bytes, word: str, gender: str) -> str:
    """A name for a word of one: its letters are a number among all words of its alphabet, which is permuted within its length and spelt in pairs of letters.

    Plain and accented words get even and odd numbers, and numbers begin at two pairs, so different words stay different and none
    is spelt as itself. An ending makes the length odd: a consonant for a man's given name, a vowel for a woman's. Words with
    other letters keep their shape.
    """
    low, script = word.lower(), unicodedata.name(word[0], "LATIN").split(" ")[0]
    plain, accented = {"LATIN": (_LETTERS[0], _LETTERS[2]), "CYRILLIC": (_LETTERS[4], "ё"), "GREEK": (_LETTERS[6], "άέήίόύώς")}.get(script, ("", ""))
    wide = any(c not in plain for c in low)
    table = plain + accented if wide else plain
    if any(c not in table for c in low):
        return _cased(word, same_shape(key, "name", low) if len(low) == len(word) else same_shape(key, "name", word))
    onsets, vowels, ends = _SOUNDS[script]
    n, radix, base = len(low), len(table), len(onsets) * len(vowels)
    number = sum(radix**k for k in range(1, n))
    for k, d in enumerate(moved(key, f"name\x1e{script}{radix}\x1e{n}", [table.index(c) for c in low], [radix] * n)):
        number += d * radix**k
    number, made = 2 * number + wide + base, []
    while number >= 0:  # pairs as digits, each number of pairs after the fewer ones
        number, d = divmod(number, base)
        number -= 1
        made.append(onsets[d // len(vowels)] + vowels[d % len(vowels)])
    out = "".join(made)
    if gender:
        out += next(c for c in ends[gender] if c != out[-1])
    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize()


def _cased(pattern: str, value: str) -> str:
    """`value` with upper case where `pattern` has it, for letters that have one of their own."""
    return "".join(u if p.isupper() and len(u := v.upper()) == 1 else v for p, v in zip(pattern, value))


def _name(key: bytes, value: str, gender: str) -> str:
    """Each word by itself; the last is the surname, which has no gender."""
    words = re.split(r"([ -])", value)
    return "".join(w if w in (" ", "-", "") or w.islower() else _word_name(key, w, gender if k + 1 < len(words) else "") for k, w in enumerate(words))


def _iban(key: bytes, value: str) -> str:
    """The account is permuted; check digits that are right stay so, and wrong ones stay as far from the right ones. Digits keep their scripts."""
    flat = _ascii_digits(value.replace(" ", ""))
    right = lambda account: 98 - int("".join(str(int(c, 36)) for c in account + flat[:2] + "00")) % 97
    account, check = same_shape(key, "iban" + flat[:2], flat[4:]), int(flat[2:4])
    if 2 <= check <= 98:
        check = (right(account) - 2 + check - right(flat[4:])) % 97 + 2
    new = iter(f"{flat[:2]}{check:02d}{account}")
    return _scripts("".join(c if c == " " else next(new) for c in value), value)


def _small(value: str) -> str:
    """Small letters, each for itself, with one kind of sigma."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value).replace("ς", "σ")


def _ascii_digits(value: str) -> str:
    return value if value.isascii() else re.sub(r"\d", lambda m: str(int(m[0])), value)


def _scripts(value: str, like: str) -> str:
    """`value` with each digit in the script of the digit that `like` has there."""
    return value if like.isascii() else "".join(chr(ord(c) - unicodedata.digit(c) + int(v)) if v.isdecimal() and c.isdecimal() else v for v, c in zip(value, like))


def surrogate(e: Entity, key: bytes = KEY) -> str:
    """The replacement of an entity; equal values of one kind get equal ones, upper and lower case apart."""
    v = e.value
    if e.kind == "card":
        digits = _ascii_digits(re.sub(r"\D", "", v))
        off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
        body = same_shape(key, "card", digits[:-1])
        new = iter(body + str((_luhn(body) + off) % 10))
        return _scripts(re.sub(r"\d", lambda m: next(new), v), v)
    if e.kind == "ip":
        parts = moved(key, "ip", [int(x) for x in v.split(".")], [256] * 4)
        return ".".join(map(str, parts))
    if e.kind == "phone":
        v = _ascii_digits(v)
        head = re.match(r"\+\d{1,3}", v)
        keep = head.end() if head else 0
        fixed = v.find("555", keep)
        digits = [k for k, c in enumerate(v) if c.isdigit() and k >= keep and not (fixed >= 0 and fixed <= k < fixed + 3)]

        def spelt(new: list[int]) -> str:
            out = list(v)
            for k, d in zip(digits, new):
                out[k] = str(d)
            return "".join(out)

        # a 555 stays where it is, so none may come up before it
        return spelt(moved(key, "phone\x1e" + re.sub(r"\d", "0", v), [int(v[k]) for k in digits], [10] * len(digits), lambda new: spelt(new).find("555", keep) == fixed))
    if e.kind == "email":
        low = _small(v)
        local, _, domain = low.rpartition("@")
        name, _, top = domain.rpartition(".")
        host = domain if _RESERVED.search(domain) else same_shape(key, "host", name, kept=lambda x: not _RESERVED.search(f"{x}.{top}")) + "." + top
        return _cased(v, same_shape(key, "email\x1e" + domain, local) + "@" + host)
    if e.kind == "ip6":
        number = int(ipaddress.IPv6Address(v))
        groups = moved(key, "ip6", [number >> 16 * k & 0xFFFF for k in range(8)], [1 << 16] * 8)
        new = ipaddress.IPv6Address(sum(g << 16 * k for k, g in enumerate(groups)))
        text = str(new) if "::" in v else new.exploded
        return text.upper() if any(c in "ABCDEF" for c in v) else text
    if e.kind in ("hex", "secret"):
        if not _HEXES.fullmatch(v):
            return same_shape(key, e.kind, v, kept=lambda x: not _HEXES.fullmatch(x))
        digits = _HEX.upper() if re.search("[A-F]", v) else _HEX
        return same_shape(key, "hex", v, lambda c: digits, _HEXES.fullmatch)
    if e.kind == "iban":
        return _iban(key, v)
    if e.kind == "name":
        return _name(key, v, e.gender)
    return same_shape(key, e.kind, v)


def _gendered(found: list[Entity]) -> list[Entity]:
    """Names without a gender get that of the same surname elsewhere in the text, where it is only one."""
    surname = lambda e: re.split("[ -]", e.value)[-1].casefold()
    known: dict[str, set[str]] = {}
    for e in found:
        if e.gender:
            known.setdefault(surname(e), set()).add(e.gender)
    return [replace(e, gender=min(g)) if e.kind == "name" and not e.gender and len(g := known.get(surname(e), ())) == 1 else e for e in found]


#: A word that can be a mention, with what may follow an apostrophe.
_WORD = re.compile(r"(?<![\w@.-])[^\W\d_a-z]\w*(?:['’]\w+)*")
_APOSTROPHE = re.compile("['’]")


def _mentions(text: str, found: list[Entity], key: bytes) -> list[tuple[Entity, str]]:
    """All entities with their surrogates, and other mentions of the words of names, in order; the first name that has a word tells its surrogate.

    One pass over the words of the text, each looked up, so the time follows the text, however many names it has. A mention may be in capitals.
    """
    pairs = [(e, surrogate(e, key)) for e in found]
    words: dict[str, str] = {}
    for e, s in pairs:
        if e.kind == "name":
            for w, x in zip(re.split("[ -]", e.value), re.split("[ -]", s)):
                if len(w) > 1 and not w.islower() and "." not in w:
                    words.setdefault(w.casefold(), x)
    if not words:
        return pairs
    taken, at, out = [(e.begin, e.end) for e in found], 0, []
    for m in _WORD.finditer(text):
        ends = [m.end(), *(m.start() + k.start() for k in reversed(list(_APOSTROPHE.finditer(m[0]))))]
        end = next((k for k in ends if text[m.start() : k].casefold() in words), 0)
        if not end or text[end : end + 1] == "@":
            continue
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            w = text[m.start() : end]
            new = words[w.casefold()]
            out.append((Entity("name", m.start(), end, w), new.upper() if w.isupper() else new))
    return sorted(pairs + out, key=lambda x: x[0].begin)


def replaced(text: str | None, key: bytes = KEY) -> tuple[str | None, list[tuple[Entity, str]]]:
    """The text with surrogates, and what was replaced by what."""
    if not text or not (found := find(text)):
        return text, []
    out, at, pairs = [], 0, _mentions(text, _gendered(found), key)
    for e, s in pairs:
        out += [text[at : e.begin], s]
        at = e.end
    out.append(text[at:])
    return "".join(out), pairs


def _plain(value: str) -> str:
    return _ascii_digits(re.sub("[ -]", "", value))


def _identity(e: Entity) -> bytes:
    """What makes an entity: case doesn't count in names and mail addresses, leading zeros don't in addresses, nor the script of digits in phones, cards and accounts, nor gaps in the last two."""
    same = {"name": str.casefold, "email": _small, "ip6": lambda v: ipaddress.IPv6Address(v).exploded, "ip": lambda v: ".".join(str(int(x)) for x in v.split(".")), "phone": _ascii_digits, "card": _plain, "iban": _plain}
    v = same[e.kind](e.value) if e.kind in same else e.value
    return v.encode("utf-8", "replace")


def _spelling(e: Entity, s: str) -> str:
    """A surrogate as far as it tells entities apart."""
    return _small(s) if e.kind in ("email", "ip6", "name") else _plain(s) if e.kind in ("card", "iban") else _ascii_digits(s) if e.kind == "phone" else s


def _marks(pairs: list[tuple[Entity, str]]) -> list[dict]:
    """Where the surrogates stand in the new text, with a hash of each and one of its entity."""
    out, moved_by = [], 0
    for e, s in pairs:
        begin = e.begin + moved_by
        moved_by += len(s) - len(e.value)
        name = hashlib.blake2b(f"{e.kind}\x1f{_spelling(e, s)}".encode("utf-8", "replace"), digest_size=16).digest()
        entity = int.from_bytes(hashlib.blake2b(_identity(e), digest_size=8).digest(), "big", signed=True)
        out.append({"kind": e.kind, "begin": begin, "end": begin + len(s), "name": name, "entity": entity})
    return out


_MARK_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("name", pa.binary()), ("entity", pa.int64())]))
_MARK_SQL = "array<struct<kind:string,begin:int,end:int,name:binary,entity:bigint>>"
#: How often surrogates that are shared are made anew before their kinds stand for them.
TRIES = 4


def _remade(text: str, marks: list[dict], shared: set[bytes], key: bytes, last: bool) -> tuple[str, list[dict]]:
    """The text with the shared surrogates made anew, each under a key of its entity; by their kinds in the `last` try."""
    pairs = []
    for m in marks:
        e = Entity(m["kind"], m["begin"], m["end"], text[m["begin"] : m["end"]])
        pairs.append((e, (f"[{e.kind}]" if last else surrogate(e, key + m["entity"].to_bytes(8, "big", signed=True))) if m["name"] in shared else e.value))
    out, at = [], 0
    for e, s in pairs:
        out += [text[at : e.begin], s]
        at = e.end
    new = [{**x, "entity": m["entity"]} for x, m in zip(_marks(pairs), marks) if not (last and m["name"] in shared)]
    return "".join([*out, text[at:]]), new


def distinct(rows: DataFrame, text_col: str, marks: str, key: bytes = KEY, size_col: str = "") -> DataFrame:
    """`rows`, stored, with texts in which no surrogate stands for two entities of the table; the column `marks` tells where they are, and goes; `size_col` has lengths.

    Surrogates differ by construction, so that one grouping of the stored hashes is all that is done. Should some be shared (a spelling that two
    entities have), the rows that hold them are found by a join, and theirs are made anew from their entities' hashes; nothing fails.
    """
    own, size_at = unused(rows, "row"), rows.columns.index(size_col) if size_col else -1
    table = cut(rows.withColumn(own, F.monotonically_increasing_id()), "surrogates")
    for k in range(TRIES):
        each = table.select(F.col(own).alias("r"), F.explode(marks).alias("m")).select("r", "m.name", "m.entity")
        shared = each.groupBy("name").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).filter("lo <> hi").select("name")
        shared = cut(shared, "shared")
        if not shared.limit(1).count():
            break
        hit = cut(each.join(shared, "name", "left_semi").groupBy("r").agg(F.collect_set("name").alias("names")), "hit")
        names = unused(table, "names")
        joined = table.join(hit.select(F.col("r").alias(own), F.col("names").alias(names)), own, "left").select(*table.columns, names)
        at, mark_at, last = table.columns.index(text_col), table.columns.index(marks), k == TRIES - 1

        def run(batches: Iterator[pa.RecordBatch], at=at, mark_at=mark_at, last=last, k=k) -> Iterator[pa.RecordBatch]:
            for part in row_slices(batches, text_col):
                columns = list(part.columns)
                texts, marked, shares = columns[at].to_pylist(), columns[mark_at].to_pylist(), columns.pop().to_pylist()
                new = [_remade(t, m, set(x), key + bytes([k + 1]), last) if x else (t, m) for t, m, x in zip(texts, marked, shares)]
                if size_at >= 0:
                    columns[size_at] = pa.array(new_lengths(texts, [t for t, _ in new], columns[size_at].to_pylist()), part.schema.field(size_at).type)
                columns[at], columns[mark_at] = pa.array([t for t, _ in new], part.schema.field(at).type), pa.array([m for _, m in new], _MARK_TYPE)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

        table = cut(joined.mapInArrow(run, table.schema), "surrogates")
    return table.drop(marks, own)


def replace_entities(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """`docs` with surrogates in the text; columns and rows stay as they are, nulls and empty texts too.

    A column n_chars of the table is set to the new text's length where it was the old one's. No name of a column of `docs` is taken.
    """
    at, schema, marks = docs.columns.index(text_col), docs.schema, unused(docs, "marks")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, text_col):
            columns, old = list(part.columns), part.column(at).to_pylist()
            made = [replaced(t, key) for t in old]
            new = [t for t, _ in made]
            columns[at] = pa.array(new, part.schema.field(at).type)
            if size_at >= 0:
                columns[size_at] = pa.array(new_lengths(old, new, part.column(size_at).to_pylist()), part.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([_marks(p) for _, p in made], _MARK_TYPE)], names=[*part.schema.names, marks])

    return distinct(docs.mapInArrow(run, StructType([*schema.fields, StructField(marks, _parse_datatype_string(_MARK_SQL))])), text_col, marks, key, "n_chars" if size_at >= 0 else "")


def pii_digests(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (array of kind:count in order) of every whole text.

    Null and empty texts stay and have no entities; repeated rows and null ids give their row each. Other columns of `docs`
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            rows = [replaced(t, key) for t in part.column(1).to_pylist()]
            kinds = [[f"{k}:{n}" for k, n in sorted(Counter(e.kind for e, _ in pairs).items())] for _, pairs in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([len(p) for _, p in rows], pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array([_marks(p) for _, p in rows], _MARK_TYPE)],
                names=["doc_id", "text", "n_entities", "kinds", "marks"],
            )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return distinct(base.mapInArrow(run, f"doc_id long, text string, n_entities long, kinds array<string>, marks {_MARK_SQL}"), "text", "marks", key)


def collisions(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, entities): surrogates that stand for more than one entity of a corpus, by a hash of the entity; none are expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            rows = {(e.kind, _spelling(e, s), hashlib.sha256(_identity(e)).hexdigest()) for t in part.column(0).to_pylist() for e, s in replaced(t, key)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["kind", "surrogate", "entity"])

    pairs = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, surrogate string, entity string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")
