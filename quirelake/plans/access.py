"""Access rules: hosts, paths, addresses, content types."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters as ad
from .registry import Literal, query, table

#: Address ranges that must not be fetched.
BLOCKED = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/8", "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b::/96", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "fd00:ec2::254/128")


def glob(pattern: str) -> str:
    """A glob as an anchored regular expression; `*` crosses slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w/])", r"\\\1", c) for c in pattern) + "$"


def allowed(value: Column, allow: list[str], deny: list[str]) -> Column:
    """Denied patterns decide first; any allowed pattern makes the rest forbidden."""

    def hit(patterns: list[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | F.rlike(value, F.lit(glob(p)))
        return found

    return ~hit(deny) & (hit(allow) if allow else F.lit(True))


def address_key(ip: Column) -> Column:
    """An address as a key that sorts as its number does: its version and its bytes in hexadecimal. Null if it is none."""
    def two(n: Column) -> Column:
        return F.lpad(F.lower(F.hex(n)), 2, "0")

    def dotted(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, r"\."), lambda p: two(p.cast("long"))), "")

    low = F.lower(ip)
    tail = F.regexp_extract(low, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    # An IPv4 tail becomes two groups; then the groups on both sides of `::` are filled up to eight.
    plain = F.when(F.contains(low, F.lit(":")) & (tail != ""), F.concat(F.substring(low, F.lit(1), F.char_length(low) - F.char_length(tail)), F.substring(dotted(tail), 1, 4), F.lit(":"), F.substring(dotted(tail), 5, 4))).otherwise(low)
    left = F.filter(F.split(F.split_part(plain, F.lit("::"), F.lit(1)), ":"), lambda g: g != "")
    right = F.filter(F.split(F.when(F.contains(plain, F.lit("::")), F.split_part(plain, F.lit("::"), F.lit(2))).otherwise(""), ":"), lambda g: g != "")
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    six = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(F.contains(low, F.lit(":")), F.concat(F.lit("6:"), six)).when(F.rlike(low, F.lit(r"^\d+(\.\d+){3}$")), F.concat(F.lit("4:"), dotted(low)))


def blocked_addresses(addresses: DataFrame, ip: str = "ip") -> DataFrame:
    """(ip, blocked) by a range join of the addresses' keys with the fixed, broadcast ranges; IPv4 addresses mapped into IPv6
    count as both. What isn't an address is blocked."""
    nets = [ipaddress.ip_network(n) for n in BLOCKED]
    rows = [(f"{n.version}:{n.network_address.packed.hex()}", f"{n.version}:{n.broadcast_address.packed.hex()}") for n in nets]
    ranges = addresses.sparkSession.createDataFrame(rows, "low string, high string")
    key = address_key(F.col(ip))
    mapped = F.when(F.startswith(key, F.lit("6:" + "0" * 20 + "ffff")), F.concat(F.lit("4:"), F.substring(key, 27, 8)))
    placed = addresses.select(ip).distinct().withColumn("k", F.explode(F.array(F.coalesce(key, F.lit("")), F.coalesce(mapped, key, F.lit("")))))
    joined = placed.join(F.broadcast(ranges), F.col("k").between(F.col("low"), F.col("high")), "left")
    return joined.groupBy(ip).agg(F.bool_or(F.col("low").isNotNull() | (F.col("k") == "")).alias("blocked"))


_HOSTS = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"SELECT page_id, NOT regexp_matches(lower({_HOSTS}), '^m\\..*$') AND (regexp_matches(lower({_HOSTS}), '^.*\\.example\\.com$') OR regexp_matches(lower({_HOSTS}), '^.*\\.example\\.net$')) AS allowed, starts_with(url, 'https://') AS secure FROM pages")
def access_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(ad.host(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", allowed(host, ["*.example.com", "*.example.net"], ["m.*"]).alias("allowed"), F.startswith("url", F.lit("https://")).alias("secure"))


PATHS = Literal("path string", ("/data/reports/a.pdf",), ("/data/private/x.pdf",), ("/tmp/b.pdf",), ("/data/reports/sub/c.txt",))


@query(f"WITH {PATHS.cte('t')} SELECT path, NOT regexp_matches(path, '^/data/private/.*$') AND regexp_matches(path, '^/data/.*$') AND ends_with(path, '.pdf') AS allowed FROM t")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PATHS.df(spark).select("path", (allowed(F.col("path"), ["/data/*"], ["/data/private/*"]) & F.endswith("path", F.lit(".pdf"))).alias("allowed"))


ADDRESSES = Literal("ip string", *[(ip,) for ip in ("8.8.8.8", "10.1.2.3", "172.31.255.1", "172.32.0.1", "127.0.0.1", "169.254.169.254", "100.100.0.1", "224.0.0.1", "0.1.2.3", "::1", "::", "::2", "2001:db8::5", "2001:db9::5", "2606:4700:4700::1111", "fe80::1", "febf:ffff::1", "fec0::1", "FD12::9", "fb00::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::8.8.8.8", "100::7", "100:0:0:1::7", "1:2:3:4:5:6:7:8")])
#: The same decided by Python's own library.
_JUDGED = Literal("ip string, blocked boolean", *[(ip, any(ipaddress.ip_address(ip) in ipaddress.ip_network(n) for n in BLOCKED if ipaddress.ip_network(n).version == ipaddress.ip_address(ip).version)) for (ip,) in ADDRESSES.rows])


@query(f"WITH {_JUDGED.cte('t')} SELECT ip, blocked FROM t")
def ssrf_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both versions in a blocked range; the SQL has the decisions of another implementation as literals."""
    return blocked_addresses(ADDRESSES.df(spark))


TYPES = Literal("id long, content_type string", (0, "application/pdf"), (1, "text/html; charset=utf-8"), (2, "IMAGE/png"), (3, "application/octet-stream"), (4, None))


@query(f"WITH {TYPES.cte('t')} SELECT id, coalesce(starts_with(lower(content_type), 'text/html') OR starts_with(lower(content_type), 'image/'), FALSE) AS denied FROM t")
def content_type_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = F.array(F.lit("text/html"), F.lit("image/"))
    return TYPES.df(spark).select("id", F.coalesce(F.exists(prefixes, lambda p: F.startswith(F.lower("content_type"), p)), F.lit(False)).alias("denied"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^.*/', '') AS base FROM pages)
    SELECT page_id, regexp_matches(url, '^https?://') AS is_url, substr(sha256(url), 1, 16) || CASE WHEN ends_with(lower(base), '.pdf') THEN '_' || regexp_replace(base, '[^A-Za-z0-9._\-]', '', 'g') ELSE '.pdf' END AS cache_name FROM u""")
def url_cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), "^.*/", "")
    named = F.when(F.endswith(F.lower("base"), F.lit(".pdf")), F.concat(F.lit("_"), F.regexp_replace("base", r"[^A-Za-z0-9._\-]", ""))).otherwise(".pdf")
    pages = table(spark, sf_dir, "pages").withColumn("base", base)
    return pages.select("page_id", F.rlike("url", F.lit("^https?://")).alias("is_url"), F.concat(F.substring(F.sha2("url", 256), 1, 16), named).alias("cache_name"))
