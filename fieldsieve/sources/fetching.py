"""Reading pages: one task a host with a least gap between its requests, bounded reads, checked addresses; and redirects as joins.

A request is one GET without following anything: `read_pages` takes a table of URLs, the data source `pages` a short list. `follow`
takes requests through their redirects, each hop checked before it is asked for, whatever answers: the network or a table of responses.
"""

from __future__ import annotations

import functools
import http.client
import ipaddress
import socket
import ssl
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import BLOCKED_IPV4, BLOCKED_IPV6, canonical, host, resolved, unsafe
from ..operators.once import called_once, new_store
from ..tables import cut, hot_join, unused

# Seconds, bytes, hops, milliseconds, statuses.
TIMEOUT, MOST_BYTES, MOST_HOPS, GAP_MS = 20.0, 5 << 20, 5, 1000
REDIRECTS = [301, 302, 303, 307, 308]

RESPONSE = "url string, http_status int, location string, content_type string, content binary, response_bytes long, duration_ms long, at_ms long, error string"
_ARROW = pa.schema([("url", pa.string()), ("http_status", pa.int32()), ("location", pa.string()), ("content_type", pa.string()), ("content", pa.binary()), ("response_bytes", pa.int64()), ("duration_ms", pa.int64()), ("at_ms", pa.int64()), ("error", pa.string())])


@functools.cache
def _networks() -> list:
    return [ipaddress.ip_network(f"{n}/{b}") for n, b in BLOCKED_IPV4 + BLOCKED_IPV6]


def blocked(address: str) -> bool:
    """Whether an address is reserved, or an IPv4 one in IPv6 clothes."""
    a = ipaddress.ip_address(address.partition("%")[0])
    return a.version == 6 and a.ipv4_mapped is not None or any(a.version == n.version and a in n for n in _networks())


@dataclass(frozen=True)
class Settings:
    timeout: float = TIMEOUT
    most_bytes: int = MOST_BYTES
    gap_ms: int = GAP_MS
    accept: str = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
    agent: str = "fieldsieve"
    #: Addresses that are asked though they are reserved; for tests on a machine's own addresses.
    trusted: tuple[str, ...] = ()


class Refused(Exception):
    """Why a request wasn't made, or its answer not read: the `error` of its row."""


def _addresses(name: str, port: int, settings: Settings) -> list[str]:
    try:
        found = list(dict.fromkeys(x[4][0] for x in socket.getaddrinfo(name, port, type=socket.SOCK_STREAM)))
    except OSError:
        raise Refused("unresolved") from None
    if not found:
        raise Refused("unresolved")
    if any(blocked(a) and a not in settings.trusted for a in found):
        raise Refused("blocked_address")
    return found


def get(url: str, settings: Settings = Settings()) -> dict:
    """One answer to a GET, as a row of RESPONSE; what goes wrong is its error: unresolved, blocked_address, timeout, connection, too_large, empty.

    All addresses of the name are checked, and the connection goes to one of those. The body is read in parts, never more than
    `most_bytes`, and `timeout` bounds the whole request. Answers that redirect, and failures, are not read.
    """
    began, parts = time.monotonic(), urlsplit(url)
    row: dict = dict.fromkeys(_ARROW.names) | {"url": url, "at_ms": time.time_ns() // 1_000_000}
    left = lambda: began + settings.timeout - time.monotonic()
    connection = None
    try:
        secure, name = parts.scheme == "https", parts.hostname or ""
        port = parts.port or (443 if secure else 80)
        addresses = _addresses(name, port, settings)
        connection = http.client.HTTPSConnection(name, port, timeout=left(), context=ssl.create_default_context()) if secure else http.client.HTTPConnection(name, port, timeout=left())
        connection._create_connection = lambda _, *more: socket.create_connection((addresses[0], port), max(left(), 0.001))  # the address that was checked
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"accept": settings.accept, "user-agent": settings.agent})
        sock = connection.sock
        sock.settimeout(max(left(), 0.001))
        answer = connection.getresponse()
        row |= {"http_status": answer.status, "location": answer.getheader("location"), "content_type": answer.getheader("content-type")}
        if 200 <= answer.status < 300:
            declared = answer.getheader("content-length", "")
            if declared.isdigit() and int(declared) > settings.most_bytes:
                raise Refused("too_large")
            chunks, size = [], 0
            while True:
                if left() <= 0:
                    raise TimeoutError
                if answer.fp is not None and not answer.isclosed():
                    sock.settimeout(max(left(), 0.001))
                chunk = answer.read1(min(65536, settings.most_bytes + 1 - size))
                if not chunk:
                    break
                chunks.append(chunk)
                if (size := size + len(chunk)) > settings.most_bytes:
                    raise Refused("too_large")
            row |= {"content": b"".join(chunks), "response_bytes": size}
            if not size:
                raise Refused("empty")
    except Refused as e:
        row["error"] = str(e)
    except TimeoutError:
        row["error"] = "timeout"
    except (OSError, http.client.HTTPException, ValueError):
        row["error"] = "connection"
    finally:
        if connection is not None:
            connection.close()
    row["duration_ms"] = round((time.monotonic() - began) * 1000)
    return row


def _answers(urls: Iterator[str], settings: Settings) -> Iterator[dict]:
    """Answers in order; between the ends and beginnings of a host's requests lie at least `gap_ms`."""
    last: tuple[str, float] = ("", 0.0)
    for url in urls:
        try:
            name = urlsplit(url).hostname or ""
        except ValueError:
            name = ""
        if name == last[0]:
            time.sleep(max(0.0, last[1] + settings.gap_ms / 1000 - time.monotonic()))
        last = (name, time.monotonic())
        yield get(url, settings)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """A batch for about 8 MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += r["response_bytes"] or 0
        if size > 8 << 20 or len(held) == 256:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def read_pages(urls: DataFrame, settings: Settings = Settings(), path: str | None = None, url: str = "url") -> DataFrame:
    """(RESPONSE) of each distinct URL, asked for once: what was read is stored, at `path` if that is given, where a later run finds it.

    URLs are dealt to tasks by host and sorted by it, so a host has one task, which waits; a host's own number of URLs is the one thing that more
    machines don't shorten. Give normal forms that passed `unsafe`; null URLs are left out.
    """

    def ask(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(_answers((u for b in batches for u in b.column(0).to_pylist()), settings))

        by_host = rows.select("url", host(F.col("url")).alias("host"))
        return by_host.repartition("host").sortWithinPartitions("host", "url").select("url").mapInArrow(run, RESPONSE)

    wanted = urls.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct()
    return called_once(wanted, ["url"], ask, path or new_store(urls.sparkSession, "pages"))


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").splitlines() if u.strip()]
        self.settings = Settings(float(options.get("timeout", TIMEOUT)), int(options.get("mostbytes", MOST_BYTES)), int(options.get("gapms", GAP_MS)), trusted=tuple(filter(None, options.get("trusted", "").split(","))))
        if not 0 <= self.settings.gap_ms <= 60_000:
            raise ValueError("gapMs is from 0 to 60000")

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(u).hostname or "", []).append(u)
        return [_Host(us) for us in hosts.values()] or [_Host([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(_answers(iter(partition.urls), self.settings))


class PagesSource(DataSource):
    """spark.read.format("pages").option("urls", one a line): a partition for each host. Options: timeout (seconds), mostBytes, gapMs, trusted.

    For lists that stand in a command; `read_pages` takes tables of any size. Reading it twice asks twice.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagesSource)


def _read_error(r: str, most_bytes: int) -> Column:
    """What is wrong with an answer that ends a chain; null where nothing is."""
    c = lambda name: F.col(f"{r}.{name}")
    size = F.coalesce(c("response_bytes"), F.lit(0))
    return F.when(c("error").isNotNull(), c("error")).when(~c("http_status").between(200, 299), "http_status").when(size > most_bytes, "too_large").when(size == 0, "empty")


def follow(requests: DataFrame, respond: Callable[[DataFrame], DataFrame], keys: list[str], url: str = "url", domains: str = "domains", most_hops: int = MOST_HOPS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`keys` of each request with final_url, hops, error, and the last answer's http_status, content_type, content, response_bytes.

    `respond` maps distinct URLs (url) to answers (RESPONSE, each URL once at most). A request starts at its URL in normal form; before each hop the
    URL is checked (`unsafe`, with the request's allowed domains): scheme, credentials, address, domain. A redirect leads on, resolved against where
    it stands; without a location it is `no_location`, after `most_hops` of them `redirects`, so loops end as well. A URL that nothing answers is
    `unanswered`. Requests with the same place share one answer, and a place where very many meet is broadcast. Null URLs are `scheme`.
    """
    answer = [x.split(" ")[0] for x in RESPONSE.split(", ")][1:]
    own = requests.select(*keys, canonical(F.col(url)).alias("at"), F.col(domains).alias("allowed"), F.lit(0).alias("hops"))
    open_, done = cut(own, "hop"), []
    for hop in range(most_hops + 1):
        checked = open_.withColumn("error", unsafe(F.col("at"), F.coalesce("allowed", F.array().cast("array<string>"))))
        none = F.lit(None).cast("struct<http_status:int,location:string,content_type:string,content:binary,response_bytes:bigint,duration_ms:bigint,at_ms:bigint,error:string>")
        done.append(checked.filter("error IS NOT NULL").withColumn("r", none))
        free = checked.filter("error IS NULL").drop("error")
        answers = cut(respond(free.select(F.col("at").alias("url")).distinct()).select(F.col("url").alias("at"), F.struct(*answer).alias("r")), "answers")
        met = cut(hot_join(free, answers, "at", "left"), "met")
        moved = F.col("r.http_status").isin(REDIRECTS) & F.col("r.error").isNull()
        error = F.when(F.col("r").isNull(), "unanswered").when(moved & F.col("r.location").isNull(), "no_location").when(moved & (F.col("hops") >= most_hops), "redirects").otherwise(_read_error("r", most_bytes))
        goes_on = F.coalesce(moved & F.col("r.location").isNotNull() & (F.col("hops") < most_hops), F.lit(False))
        done.append(met.filter(~goes_on).withColumn("error", error))
        on = met.filter(goes_on).select(*keys, canonical(resolved(F.col("at"), F.col("r.location"))).alias("at"), "allowed", (F.col("hops") + 1).alias("hops"))
        open_ = cut(on, "hop")
        if not open_.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    kept = F.col("error").isNull()
    return out.select(*keys, F.col("at").alias("final_url"), "hops", "error", "r.http_status", "r.content_type", F.when(kept, F.col("r.content")).alias("content"), F.when(kept, F.col("r.response_bytes")).alias("response_bytes"))


def from_table(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A `respond` of stored answers (RESPONSE)."""
    return lambda urls: responses.join(urls, "url", "left_semi")
