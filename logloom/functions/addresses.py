"""IP addresses and networks as fixed-width hexadecimal text, so ranges compare as strings.

An IPv4 address has 8 digits and an IPv6 address 32; different widths never compare equal,
which keeps the two families apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.binding import bind
from logloom.functions.literals import strip

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_TEXT = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_IPV4_TAIL = rf"^(.*:)({_OCTET}(?:\.{_OCTET}){{3}})$"
_HEX_DIGITS = "0123456789abcdef"


def _ipv4_number(text: Column) -> Column:
    total = F.lit(0).cast("bigint")
    for octet in (1, 2, 3, 4):
        part = F.substring_index(F.substring_index(text, ".", octet), ".", -1)
        total = total * 256 + part.try_cast("bigint")
    return total


def _fixed_hex(number: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), width, "0")


def _ipv6_hex(text: Column) -> Column:
    tail = F.regexp_extract(text, _IPV4_TAIL, 2)
    number = _ipv4_number(tail)
    low_groups = F.concat(
        F.regexp_extract(text, _IPV4_TAIL, 1),
        F.hex(F.shiftright(number, 16)),
        F.lit(":"),
        F.hex(number.bitwiseAND(F.lit(0xFFFF))),
    )
    plain = F.when(tail != "", low_groups).otherwise(text)

    def groups_of(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    def expand(full: Column) -> Column:
        halves = F.split(full, "::", -1)
        left, right = groups_of(F.get(halves, F.lit(0))), groups_of(F.get(halves, F.lit(1)))
        missing = 8 - F.size(left) - F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        groups = F.when((F.size(halves) == 2) & (missing >= 1), filled).when(F.size(halves) == 1, F.split(full, ":", -1))
        return bind(
            groups,
            lambda g: F.when(
                (F.size(g) == 8) & F.forall(g, lambda part: part.rlike("^[0-9a-fA-F]{1,4}$")),
                F.lower(F.array_join(F.transform(g, lambda part: F.lpad(part, 4, "0")), "")),
            ),
        )

    return bind(plain, expand)


def address_hex(text: Column) -> Column:
    """Hex form of an address (a zone after '%' is ignored), null when it is not one."""
    bare = F.regexp_replace(text, "%[^%]+$", "")
    return (
        F.when(text.rlike(IPV4_TEXT), _fixed_hex(_ipv4_number(text), 8))
        .when(bare.contains(":"), _ipv6_hex(bare))
    )


def address_zone(text: Column) -> Column:
    return F.when(text.contains(":"), F.nullif(F.regexp_extract(text, "%([^%]+)$", 1), F.lit("")))


def _prefix_length(mask: Column, width: Column) -> Column:
    """Prefix length from digits, or for IPv4 from a net mask or host mask."""
    full = (1 << 32) - 1
    number = _ipv4_number(mask)

    def from_mask(value: Column) -> Column:
        rest = F.lit(full) - value
        is_net = rest.bitwiseAND(rest + 1) == 0
        is_host = value.bitwiseAND(value + 1) == 0
        return F.when(is_net, F.bit_count(value)).when(is_host, 32 - F.bit_count(value))

    digits = F.when(F.length(mask) <= 9, mask.try_cast("int"))
    length = F.when(mask.rlike("^[0-9]+$"), digits).when(
        (width == 8) & mask.rlike(IPV4_TEXT), bind(number, from_mask)
    )
    return F.when(length <= width * 4, length)


def _hex_digit(value: Column) -> Column:
    return F.lit(_HEX_DIGITS).substr((value + 1).cast("int"), F.lit(1))


def _range_of(address: Column, prefix: Column) -> Column:
    whole, rest = F.floor(prefix / 4).cast("int"), F.pmod(prefix, F.lit(4))
    size = F.pow(F.lit(2), 4 - rest).cast("int")
    digit = F.instr(F.lit(_HEX_DIGITS), address.substr(whole + 1, F.lit(1))) - 1
    base = digit - F.pmod(digit, size)
    kept = address.substr(F.lit(1), whole)
    low = F.when(rest == 0, kept).otherwise(F.concat(kept, _hex_digit(base)))
    high = F.when(rest == 0, kept).otherwise(F.concat(kept, _hex_digit(base + size - 1)))
    width = F.length(address)
    return F.struct(
        F.call_function("rpad", low, width, F.lit("0")).alias("low"),
        F.call_function("rpad", high, width, F.lit("f")).alias("high"),
        F.lit(None).cast("string").alias("zone"),
        F.lit(True).alias("is_network"),
    )


def _entry_range(entry: Column) -> Column:
    """(low, high, zone, is_network) of one allowlist entry, null when it is not valid."""
    parts = F.split(entry, "/", -1)
    single = F.struct(
        address_hex(entry).alias("low"),
        address_hex(entry).alias("high"),
        address_zone(entry).alias("zone"),
        F.lit(False).alias("is_network"),
    )
    network = bind(
        F.struct(address_hex(F.get(parts, F.lit(0))).alias("address"), F.get(parts, F.lit(1)).alias("mask")),
        lambda net: bind(
            F.struct(
                net["address"].alias("address"),
                _prefix_length(net["mask"], F.length(net["address"])).alias("prefix"),
            ),
            lambda ready: F.when(ready["prefix"].isNotNull(), _range_of(ready["address"], ready["prefix"])),
        ),
    )
    return F.when(~entry.contains("/"), bind(single, lambda s: F.when(s["low"].isNotNull(), s))).when(
        F.size(parts) == 2, network
    )


def allowlist_ranges(text: Column) -> Column:
    """Array of ranges of a comma-separated allowlist; bad entries are skipped."""
    entries = F.transform(F.split(text, ",", -1), lambda entry: strip(entry))
    ranges = F.transform(F.filter(entries, lambda entry: entry != ""), _entry_range)
    return F.filter(ranges, lambda r: r.isNotNull())


def digit_rules(ranges: Column) -> Column:
    """The networks of an allowlist as (width, head, digits) rules.

    A network is fixed by its leading hexadecimal digits up to the one its prefix ends in: an
    address is inside when it begins with ``head`` and its next digit's bit is set in ``digits``.
    So membership is an equality on (width, head), whatever the number of networks.
    """

    def rule(r: Column) -> Column:
        low, high = r["low"], r["high"]
        width = F.length(low)
        # the low and high ends agree up to the digit that the prefix ends in
        agreed = F.array_position(
            F.transform(F.sequence(F.lit(1), width), lambda at: low.substr(at, F.lit(1)) == high.substr(at, F.lit(1))),
            F.lit(False),
        ).cast("int")
        at = F.when(agreed == 0, width).otherwise(agreed)
        # a prefix that ends after a whole digit leaves the next one free: all its 16 bits are set
        first = _digit_value(low, at)
        count = _digit_value(high, at) - first + 1
        bits = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1), count) - 1, first)
        return F.struct(width.alias("width"), low.substr(F.lit(1), at - 1).alias("head"), bits.alias("digits"))

    return F.transform(ranges, rule)


def _digit_value(address: Column, at: Column) -> Column:
    return F.instr(F.lit(_HEX_DIGITS), address.substr(at, F.lit(1))) - 1


def digit_bit(address: Column, head: Column) -> Column:
    """Bit of the digit that follows a head."""
    return F.call_function("shiftleft", F.lit(1), _digit_value(address, F.length(head) + 1))


def in_ranges(address: Column, zone: Column, ranges: Column) -> Column:
    def hit(r: Column) -> Column:
        same_width = F.length(r["low"]) == F.length(address)
        return same_width & address.between(r["low"], r["high"]) & (r["is_network"] | r["zone"].eqNullSafe(zone))

    return F.exists(ranges, hit)
