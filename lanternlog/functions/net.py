"""IP address predicates built from string and integer arithmetic.

IPv4 becomes a 32-bit number and IPv6 a 32-digit hex string, so a network is one
range test on either. A numeric IPv4 column stored with the data keeps min/max
statistics usable for the same test.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4_number(ip: Column) -> Column:
    """Address as BIGINT, null when it is not dotted-quad IPv4."""
    octets = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * F.lit(256).cast("bigint") + F.try_element_at(octets, F.lit(i + 1)).try_cast("bigint")
    return F.when(ip.rlike(_IPV4), number)


def ipv6_hex(ip: Column) -> Column:
    """Address as 32 lower-case hex digits, null when it is not plain IPv6."""
    text = F.lower(ip)

    def digits(half: Column) -> Column:
        # Pad each group in front, then keep the last four digits of each.
        padded = F.regexp_replace(half, "([0-9a-f]+)", "0000$1")
        return F.regexp_replace(padded, "[0-9a-f]*([0-9a-f]{4})(?::|$)", "$1")

    short = text.contains("::")
    left = digits(F.substring_index(text, "::", 1))
    right = F.when(short, digits(F.substring_index(text, "::", -1))).otherwise("")
    used = F.length(left) + F.length(right)
    whole = F.concat(left, F.repeat(F.lit("0"), F.greatest(F.lit(0), 32 - used)), right)
    well_formed = text.rlike("^[0-9a-f:]+$") & ~text.rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$")
    complete = F.when(short, used < 32).otherwise(used == 32)
    return F.when(well_formed & complete, whole)


def cidr(ip: Column, network: str, number: Column | None = None) -> Column:
    """Address lies in the network. ``number`` is an already computed ``ipv4_number``."""
    return cidr_any(ip, [network], number)


def cidr_any(ip: Column, networks: Iterable[str], number: Column | None = None) -> Column:
    """Address lies in one of the networks; each address form is computed once."""
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    v4 = _in_prefixes(ipv4_number(ip) if number is None else number, [n for n in nets if n.version == 4])
    v6 = _in_ranges(
        ipv6_hex(ip),
        [(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for n in nets if n.version == 6],
    )
    if not any(n.version == 6 for n in nets):
        return v4
    return F.when(ip.contains(":"), v6).otherwise(v4)


def _in_prefixes(number: Column, nets: list[ipaddress.IPv4Network]) -> Column:
    """One network is a range, which a stored number can prune; several are tests per prefix length."""
    if len(nets) <= 1:
        return _in_ranges(number, [(int(n.network_address), int(n.broadcast_address)) for n in nets])
    by_length: dict[int, list[int]] = {}
    for net in nets:
        shift = 32 - net.prefixlen
        by_length.setdefault(shift, []).append(int(net.network_address) >> shift)
    hit = None
    for shift, values in by_length.items():
        test = F.shiftright(number, shift).isin(values)
        hit = test if hit is None else hit | test
    return F.coalesce(hit, F.lit(False))


def _in_ranges(value: Column, ranges: list[tuple]) -> Column:
    if not ranges:
        return F.lit(False)
    hit = value.between(*map(F.lit, ranges[0]))
    for first, last in ranges[1:]:
        hit = hit | value.between(F.lit(first), F.lit(last))
    return F.coalesce(hit, F.lit(False))


def direction(source_ip: Column, destination_ip: Column, home: Iterable[str]) -> Column:
    """Flow direction relative to the home networks; null when an end is unknown."""
    home = list(home)
    src, dst = cidr_any(source_ip, home), cidr_any(destination_ip, home)
    return F.when(
        source_ip.isNotNull() & destination_ip.isNotNull(),
        F.when(src, F.when(dst, "internal").otherwise("outbound")).otherwise(
            F.when(dst, "inbound").otherwise("external")
        ),
    )
