"""IPv4 and IPv6 addresses as two numbers, and networks of any number by equality joins; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..tables import cut, unused
from .text import let

_GROUP = "[0-9a-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _octets(text: Column) -> Column:
    """An IPv4 address as a number."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x))


def numbers(text: Column) -> Column:
    """A struct (version, hi, lo) of an address, or null for what is none: hi and lo are 64 bits each, as longs; IPv4 has its 32 bits in lo.

    IPv6 in every spelling: capitals, `::` once at most, an IPv4 address in its last 32 bits. A zone (`%eth0`) is left out.
    """
    make = lambda v, hi, lo: F.struct(F.lit(v).alias("version"), hi.alias("hi"), lo.alias("lo"))
    side = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    shape = rf"^(?:{_GROUP}(?::{_GROUP})*)?(?:::(?:{_GROUP}(?::{_GROUP})*)?)?$"
    half = lambda value, at: F.aggregate(F.slice(value, at, 4), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 16).bitwiseOR(x))

    def hexed(n: Column) -> Column:
        return F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))

    def v6(whole: Column) -> Column:
        short, left = F.contains(whole, F.lit("::")), side(F.substring_index(whole, "::", 1))
        right = F.when(short, side(F.substring_index(whole, "::", -1))).otherwise(F.array().cast("array<string>"))

        def of(s: Column) -> Column:
            missing = F.lit(8) - F.size(s["left"]) - F.size(s["right"])
            groups = F.concat(s["left"], F.array_repeat(F.lit("0"), F.when(short, F.greatest(missing, F.lit(0))).otherwise(0)), s["right"])
            good = F.regexp_like(whole, F.lit(shape)) & F.when(short, missing >= 1).otherwise(missing == 0)
            return F.when(good, let(F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long")), lambda value: make(6, half(value, 1), half(value, 5))))

        return let(F.struct(left.alias("left"), right.alias("right")), of)

    def any_(t: Column) -> Column:
        tail = F.regexp_extract(t, rf":({_V4})$", 1)
        whole = F.when(tail != "", F.concat(F.substr(t, F.lit(1), F.length(t) - F.length(tail)), let(_octets(tail), hexed))).otherwise(t)
        return F.when(F.regexp_like(t, F.lit(f"^{_V4}$")), make(4, F.lit(0).cast("long"), _octets(t))).when(F.contains(t, F.lit(":")), let(whole, v6))

    return let(F.lower(F.substring_index(text, "%", 1)), any_)


def _kept(n: Column, bits: Column) -> Column:
    """The first `bits` bits of a long; all of them for 64 and more, none for 0 and less."""
    return F.when(bits >= 64, n).when(bits <= 0, F.lit(0).cast("long")).otherwise(n.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - bits)))


def prefix(address: Column, bits: Column) -> Column:
    """`numbers` with what is behind the first `bits` bits cleared; of IPv4 these count among its 32."""
    of = bits + F.when(address["version"] == 4, 96).otherwise(0)
    return F.struct(address["version"].alias("version"), _kept(address["hi"], of).alias("hi"), _kept(address["lo"], of - 64).alias("lo"))


def parsed_networks(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """`networks` with net (version, hi, lo) and bits; null both where the text is no network. A network without bits is one address."""
    own, bits = unused(networks, "address"), F.regexp_extract(cidr, r"/([0-9]{1,3})$", 1)
    rows = networks.withColumn(own, numbers(F.substring_index(F.col(cidr), "/", 1)))
    most = F.when(F.col(own)["version"] == 4, 32).otherwise(128)
    n = F.when(bits == "", most).otherwise(bits.try_cast("int"))
    ok = F.col(own).isNotNull() & (n <= most) & (F.contains(F.col(cidr), F.lit("/")) == (bits != ""))
    rows = rows.withColumn("bits", F.when(ok, n))
    return rows.withColumn("net", F.when(F.col("bits").isNotNull(), prefix(F.col(own), F.col("bits")))).drop(own)


def outermost(networks: DataFrame) -> DataFrame:
    """Distinct (net, bits) that no other network holds. Networks hold each other or have nothing in common, so these are disjoint and cover the same."""
    each = cut(networks.filter("net IS NOT NULL").select("net", "bits").distinct(), "networks")
    lengths = sorted(r.bits for r in each.select("bits").distinct().collect())  # 129 at most
    if not lengths:
        return each
    above = each.select(F.col("net").alias("own"), F.col("bits").alias("own_bits"), F.explode(F.array(*map(F.lit, lengths))).alias("bits")).filter("bits < own_bits")
    inner = above.select("own", "own_bits", prefix(F.col("own"), F.col("bits")).alias("net"), "bits").join(each, ["net", "bits"], "left_semi").select(F.col("own").alias("net"), F.col("own_bits").alias("bits")).distinct()
    return each.join(inner, ["net", "bits"], "left_anti")


def in_networks(rows: DataFrame, address: str, networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """`rows` with in_network: whether the address is in one of the networks; null where it is none.

    The networks are reduced to disjoint ones. A distinct address is looked up by its prefixes of the lengths that occur (129 at most), so the
    work is addresses x lengths whatever the number of networks, and no range is compared.
    """
    nets = cut(outermost(parsed_networks(networks, cidr)), "networks")
    lengths = sorted(r.bits for r in nets.select("bits").distinct().collect())
    own, hit, is_one = unused(rows, "own_address"), unused(rows, "in_network"), unused(rows, "is_address")
    known = rows.select(F.col(address).alias(own)).distinct().withColumn("net", numbers(F.col(own)))
    each = known.filter("net IS NOT NULL").select(own, "net", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("bits"))
    found = each.select(own, prefix(F.col("net"), F.col("bits")).alias("net"), "bits").join(nets, ["net", "bits"], "left_semi").select(own).distinct().withColumn(hit, F.lit(True))
    verdicts = known.select(own, F.col("net").isNotNull().alias(is_one)).join(found, own, "left").select(own, F.when(F.col(is_one), F.coalesce(hit, F.lit(False))).alias(hit))
    return rows.join(verdicts, F.col(address).eqNullSafe(F.col(own)), "left").drop(own)
