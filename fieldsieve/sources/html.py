"""HTML pages: links by CSS selector, title, visible text and date candidates, in Arrow functions over the page column.

The tree is built with the standard library's parser. Selectors: type, #id, .class, [attr], [attr=v] and its ^= $= *= ~= |= forms, :not(),
:first, :first-child, :last-child, :nth-child(n), :contains(), :has(), combined by blank, >, + and ~, in comma lists.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from ..functions.dates import date_candidate
from ..tables import unused

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Where the text of a page is looked for, what isn't text, and where its date stands.
BODY_SELECTORS = ["main", "article", '[role="main"]', "#mol_contents", "#main", "#contents", "#content", ".content", "body"]
HIDDEN = frozenset("script style nav header footer aside form noscript iframe svg".split())
DATE_META = re.compile("published_time|datepublished|pubdate|publishdate")
DATE_SELECTORS = [".page_day01", ".published", ".publish-date", ".date", "#main", "main", "article", "body"]
LEAST_TEXT = 200
NO_MATCH = "no match"
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = {"div", "article", "section", "main", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "form", "dl", "pre", "aside", "blockquote"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: "Node | None" = None
    children: list = field(default_factory=list)

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator["Node"]:
        stack = [iter(self.elements())]
        while stack:
            n = next(stack[-1], None)
            if n is None:
                stack.pop()
            else:
                yield n
                stack.append(iter(n.elements()))

    def text(self, skip: frozenset | set = frozenset()) -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
            elif isinstance(c, str):
                out.append(c)
            elif c.tag not in skip and not (skip and ("hidden" in c.attrs or c.attrs.get("aria-hidden") == "true")):
                stack.append(iter(c.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES or tag in _BLOCKS:
            closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
            if self.at.tag in closes:
                self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


class SelectorError(ValueError):
    """The selector isn't understood."""


_TOKEN = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*)?\]|:(?P<pseudo>[\w-]+)(?P<open>\()?""")


def _argument(text: str, at: int) -> tuple[str, int]:
    depth = 1
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return text[at:k].strip(), k + 1
    raise SelectorError(text)


def _split(text: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            parts.append(text[last:k])
            last = k + 1
    return [*parts, text[last:]]


def _compound(text: str, at: int) -> tuple[list, int]:
    tests: list = []
    while at < len(text) and (m := _TOKEN.match(text, at)):
        at = m.end()
        if m["pseudo"]:
            arg = None
            if m["open"]:
                arg, at = _argument(text, at)
            tests.append((m["pseudo"], arg if m["pseudo"] in ("contains", "nth-child") or arg is None else compiled(arg)))
        elif m["attr"]:
            tests.append(("[]", (m["attr"].lower(), m["op"], m["v1"] if m["v1"] is not None else m["v2"] if m["v2"] is not None else m["v3"])))
        else:
            tests.append(("tag", m["tag"].lower()) if m["tag"] else ("id", m["id"]) if m["id"] else ("cls", m["cls"]))
    if not tests:
        raise SelectorError(text)
    return tests, at


@functools.lru_cache(512)
def compiled(selector: str) -> list[list[tuple[str, list]]]:
    """A list of chains of (combinator, tests)."""
    out = []
    for part in _split(selector):
        part, at, how, chain = part.strip(), 0, " ", []
        while at < len(part):
            m = re.compile(r"\s*([>+~])\s*|\s+").match(part, at)
            if m:
                how, at = m[1] or " ", m.end()
            tests, at = _compound(part, at)
            chain.append((how, tests))
            how = " "
        if not chain:
            raise SelectorError(selector)
        out.append(chain)
    return out


def _holds(n: Node, tests: list) -> bool:
    for kind, x in tests:
        if kind == "tag":
            good = x in ("*", n.tag)
        elif kind == "id":
            good = n.attrs.get("id") == x
        elif kind == "cls":
            good = x in n.attrs.get("class", "").split()
        elif kind == "[]":
            name, op, v = x
            own = n.attrs.get(name)
            good = own is not None and (op is None or {"=": own == v, "^=": v != "" and own.startswith(v), "$=": v != "" and own.endswith(v), "*=": v != "" and v in own, "~=": v in own.split(), "|=": own == v or own.startswith(v + "-")}[op])
        elif kind == "not":
            good = not any(_chain(n, c) for c in x)
        elif kind == "has":
            good = any(_chain(d, c) for d in n.walk() for c in x)
        elif kind == "contains":
            good = x.strip("\"'") in n.text()
        elif kind in ("first-child", "last-child", "nth-child"):
            row = n.parent.elements()
            want = {"first-child": 1, "last-child": len(row)}.get(kind) or (int(x) if x.isdigit() else None)
            if want is None:
                raise SelectorError(x)
            good = len(row) >= want and row[want - 1] is n
        elif kind == "first":
            good = True
        else:
            raise SelectorError(kind)
        if not good:
            return False
    return True


def _chain(n: Node, chain: list) -> bool:
    how, tests = chain[-1]
    if not _holds(n, tests):
        return False
    if len(chain) == 1:
        return True
    rest = chain[:-1]
    if how == " ":
        p = n.parent
        while p is not None and p.tag != "#root":
            if _chain(p, rest):
                return True
            p = p.parent
        return False
    if how == ">":
        return n.parent is not None and n.parent.tag != "#root" and _chain(n.parent, rest)
    row = n.parent.elements()
    k = next(i for i, x in enumerate(row) if x is n)
    return any(_chain(x, rest) for x in (row[max(0, k - 1) : k] if how == "+" else row[:k]))


def select(root: Node, selector: str) -> list[Node]:
    """Matching elements in document order."""
    chains = compiled(selector)
    found = [n for n in root.walk() if any(_chain(n, c) for c in chains)]
    return found[:1] if any(k == "first" for c in chains for k, _ in c[-1][1]) else found


def _tidy(s: str) -> str:
    return " ".join(s.replace("﻿", " ").split())


def links_of(html: str, selector: str) -> tuple[list[dict], str | None]:
    """Anchors with text, href and the text around them; an error for a selector that isn't understood or finds nothing."""
    try:
        nodes = select(parse(html), selector)
    except SelectorError as e:
        return [], f"selector not understood: {e}"
    if not nodes:
        return [], NO_MATCH
    out = []
    for n in nodes:
        around = n.parent
        while around is not None and around.tag not in ("li", "article", "section", "tr", "div") and "sec_01" not in around.attrs.get("class", "").split():
            around = around.parent
        out.append({"href": n.attrs.get("href", "").strip(), "text": _tidy(n.text()), "context": _tidy(around.text()) if around else ""})
    return out, None


def _title(root: Node, selector: str | None) -> tuple[str, str | None]:
    """The title, or an error: of the selector where there is one, else of the first h1 or the title element."""
    if selector is None:
        found = [t for s in ("h1", "title") for n in select(root, s)[:1] if (t := _tidy(n.text()))]
        return (found[0], None) if found else ("", "no title")
    try:
        nodes = select(root, selector) if selector.strip() else []
    except SelectorError:
        return "", "title selector not understood"
    text = _tidy(nodes[0].text()) if nodes else ""
    return (text, None) if text else ("", "title selector finds no text")


def document_of(root: Node, selectors: list[str], title_selector: str | None = None, body: bool = True) -> dict:
    """Title, the visible text of the first selector with LEAST_TEXT characters, its links to PDF files, and an error or null; without `body` the title alone."""
    title, error = _title(root, title_selector)
    out = {"title": title, "body": "", "selector": None, "pdf_hrefs": [], "pdf_texts": [], "base": None, "error": error}
    if not body:
        return out
    for n in select(root, "base[href]")[:1]:
        out["base"] = n.attrs["href"]
    for s in dict.fromkeys([*selectors, *BODY_SELECTORS]):
        try:
            nodes = select(root, s)
        except SelectorError:
            continue
        text = _tidy("".join(n.text(HIDDEN) for n in nodes if n.tag not in HIDDEN))
        if len(text) >= LEAST_TEXT or s == "body" and text:
            anchors = [d for n in nodes for d in ([n] if n.tag == "a" else []) + list(n.walk()) if d.tag == "a" and "href" in d.attrs]
            anchors = [d for d in anchors if re.search(r"(?i)\.pdf$", re.split("[?#]", d.attrs["href"].strip())[0])]
            return out | {"body": text, "selector": s, "pdf_hrefs": [d.attrs["href"].strip() for d in anchors], "pdf_texts": [_tidy(d.text()) for d in anchors]}
    return out | {"error": error or "no text"}


def dates_of(root: Node) -> list[tuple[str, str]]:
    """(provenance, text) in the order in which a publication date is looked for."""
    out = [("time", n.attrs.get("datetime", n.text())) for n in select(root, "time")]
    for n in select(root, "meta"):
        key = " ".join(n.attrs[k] for k in ("property", "name", "itemprop") if k in n.attrs).lower()
        if DATE_META.search(key):
            out.append(("meta", n.attrs.get("content", "")))
    return out + [("page_text", _tidy(n.text())[:5000]) for s in DATE_SELECTORS for n in select(root, s)[:1]]


def links(pages: DataFrame, html: str = "html", selector: str = "a[href]", base: str = "url") -> DataFrame:
    """A row for each anchor: the page's other columns, pos, link_url (resolved), text, context; pages without a match give none."""
    keep = [c for c in pages.columns if c != html]

    @F.pandas_udf("array<struct<href:string,text:string,context:string>>")
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: links_of(x, selector)[0] if x else [])

    rows = pages.select(*keep, F.posexplode(found(html)).alias("pos", "a"))
    return rows.select(*keep, "pos", urls.resolved(F.col(base), F.col("a.href")).alias("link_url"), F.col("a.text").alias("text"), F.col("a.context").alias("context"))


def titles(pages: DataFrame, html: str = "html", title_selector: str | None = None, references: list[str] | None = None) -> DataFrame:
    """The page's other columns, title and error: what `documents` says of them, without a look at texts, links and dates.

    By default character references are read as the HTML standard has it; where `references` names some, only those count, and only with
    their semicolon, and others stay as they are spelt.
    """
    keep = [c for c in pages.columns if c not in (html, "title", "error")]

    spelt = re.compile(f"&(?!(?:{'|'.join(map(re.escape, references))});)") if references else None

    @F.pandas_udf("title string, error string")
    def made(s: pd.Series) -> pd.DataFrame:
        s = s if spelt is None else s.map(lambda x: spelt.sub("&amp;", x or ""))
        return pd.DataFrame([{k: d[k] for k in ("title", "error")} for d in (document_of(parse(x or ""), [], title_selector, False) for x in s)], columns=["title", "error"])

    return pages.select(*keep, made(html).alias("made")).select(*keep, "made.*")


def documents(pages: DataFrame, html: str = "html", url: str | None = None, selectors: list[str] | None = None, title_selector: str | None = None) -> DataFrame:
    """The page's other columns, title, body_text, content_selector_used, used_fallback, published_at, published_at_source, pdf_links, error.

    Links are resolved against the page's base element, or its `url` where it has none or none that is http; of equal links the first stays.
    A page without a title or a text is a row with an error. Null pages are empty. Columns of the page that have a name of these are replaced.
    """
    made_names = {"title", "body_text", "content_selector_used", "used_fallback", "published_at", "published_at_source", "pdf_links", "error"}
    keep = [c for c in pages.columns if c != html and c.lower() not in made_names]
    where, base_of, when, links_at = (unused(pages.select(*keep), x) for x in ("page", "base_url", "date", "links"))
    kind = "title string, body string, selector string, pdf_hrefs array<string>, pdf_texts array<string>, base string, error string, date_at array<string>, date_text array<string>"

    @F.pandas_udf(kind)
    def made(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            root = parse(x or "")
            found = dates_of(root)
            rows.append(document_of(root, selectors or [], title_selector) | {"date_at": [k for k, _ in found], "date_text": [v for _, v in found]})
        return pd.DataFrame(rows, columns=["title", "body", "selector", "pdf_hrefs", "pdf_texts", "base", "error", "date_at", "date_text"])

    rows = pages.select(*keep, made(html).alias(where))
    of = lambda x: F.col(f"{where}.{x}")
    dated = F.filter(F.transform(F.arrays_zip(of("date_at").alias("date_at"), of("date_text").alias("date_text")), lambda z: F.struct(date_candidate(z["date_text"], True).alias("date"), z["date_at"].alias("source"))), lambda z: z["date"].isNotNull())
    rows = rows.withColumn(when, F.get(dated, F.lit(0)))
    if url:
        rows = rows.withColumn(base_of, F.coalesce(urls.resolved(F.col(url), of("base")), F.col(url)))
        rows = rows.withColumn(links_at, _resolved_all(F.col(base_of), of("pdf_hrefs"), of("pdf_texts")))
    else:
        rows = rows.withColumn(links_at, F.arrays_zip(of("pdf_hrefs").alias("url"), of("pdf_texts").alias("text")))
    return rows.select(
        *keep, of("title").alias("title"), of("body").alias("body_text"), of("selector").alias("content_selector_used"), (~of("selector").isin(selectors or [""])).alias("used_fallback"), F.col(f"{when}.date").alias("published_at"),
        F.col(f"{when}.source").alias("published_at_source"), F.col(links_at).alias("pdf_links"), of("error").alias("error"),
    )


def _resolved_all(base, hrefs, texts):
    @F.pandas_udf("array<struct<url:string,text:string>>")
    def run(b: pd.Series, h: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for root, links_, names in zip(b, h, t):
            seen: dict[str, str] = {}
            for x, name in zip(links_, names):
                try:
                    u = urljoin(root or "", x)
                    if u.startswith(("http://", "https://")):
                        seen.setdefault(urls.normal_url(u) + ("#" + u.partition("#")[2] if "#" in u else ""), name)
                except ValueError:
                    continue
            out.append([{"url": u, "text": n} for u, n in seen.items()])
        return pd.Series(out)

    return run(base, hrefs, texts)
