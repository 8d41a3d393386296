"""IP address columns, JVM-side (IPv4 and IPv6)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import let

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
IPV4_FIND_RE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
# RFC 1918 ranges, loopback and link-local count as internal.
PRIVATE_CIDRS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4_RE), F.lit(False))


def ipv4_to_long(c: Column) -> Column:
    """NULL unless ``c`` is a dotted quad."""
    number = lambda p: sum((p[i].try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), p[0].try_cast("bigint") * 256**3)
    return F.when(is_ipv4(c), let(F.split(c, r"\."), number))


def _canonical_ipv6(text: Column) -> Column:
    split_side = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))

    def groups(halves):
        head, tail = split_side(halves[0]), split_side(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = F.lit(8) - F.size(head) - F.size(tail)
        return F.when(F.size(halves) == 1, head).when(
            (F.size(halves) == 2) & (missing >= 1), F.concat(head, F.array_repeat(F.lit("0"), missing), tail))

    def squeeze(joined):
        # The leftmost longest run of two or more zero groups becomes "::".
        def cut(run):
            zeros = ":" + "0:" * run
            return F.concat(F.substring_index(joined, zeros, 1), F.lit("::"), F.substring(joined, F.instr(joined, zeros) + len(zeros), F.lit(100)))

        out = F.coalesce(*[F.when(F.instr(joined, ":" + "0:" * run) > 0, cut(run)) for run in range(8, 1, -1)], joined)
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    def join(full):
        ok = (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        text = F.array_join(F.transform(full, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
        return F.when(ok, let(F.concat(F.lit(":"), text, F.lit(":")), squeeze))

    return let(F.split(F.lower(text), "::"), lambda h: let(groups(h), join))


def normalize_ip(c: Column) -> Column:
    """Canonical address or NULL: outer quotes and blanks go, an IPv4 port goes."""
    bare = F.btrim(c, F.lit(" \t\r\n\"'"))
    # Most rows are plain IPv4 and meet no regex but the last one.
    noport = F.when(bare.contains(":") & bare.contains("."), F.regexp_replace(bare, r"(?<=\.\d{1,3}):[0-9]+$", "")).otherwise(bare)
    return let(noport, lambda t: F.when(is_ipv4(t), t).when(t.contains(":"), _canonical_ipv6(t)))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 network as integers."""
    import ipaddress

    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_cidrs(c: Column, cidrs) -> Column:
    """NULL when ``c`` is no IPv4 address; short literal lists only."""
    def test(n):
        hit = F.lit(False)
        for lo, hi in map(cidr_bounds, cidrs):
            hit = hit | n.between(lo, hi)
        return F.when(n.isNotNull(), hit)

    return let(ipv4_to_long(c), test)


def network_tag(c: Column) -> Column:
    """``private`` / ``global`` / ``invalid``."""
    return let(in_cidrs(c, PRIVATE_CIDRS), lambda inside: F.when(inside.isNull(), "invalid").when(inside, "private").otherwise("global"))


def network_attributes(ip: Column, country: Column, province: Column, city: Column) -> Column:
    """Tag and, where the log knows it, the place: an array of labels."""
    place = F.concat_ws(" / ", *[F.when(c != "", c) for c in (country, province, city)])
    return F.array_compact(F.array(network_tag(ip), F.when(F.coalesce(country, F.lit("")) != "", F.concat(F.lit("geo: "), place))))


def extract_ipv4s(c: Column) -> Column:
    """Distinct plausible addresses of a text, in order of first sight."""
    return F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({IPV4_FIND_RE})"), F.lit(1))), is_ipv4)
