"""Column helpers on edge cases."""
import hashlib
import hmac
import ipaddress

import pytest
from pyspark.sql import functions as F

from huntspark.functions import net, text as X, web
from huntspark.functions.timefn import normalize_timestamp


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw", ["2001:DB8::1", "2001:db8:0:0:1:0:0:1", "::", "::1", "1::", "fe80:0:0:0:0:0:0:1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "0:0:1:0:0:0:0:0"])
def test_ipv6_canonical(spark, raw):
    assert one(spark, raw, net.normalize_ip) == str(ipaddress.ip_address(raw))


@pytest.mark.parametrize("raw,want", [('"39.144.124.34', "39.144.124.34"), (" 1.2.3.4:80 ", "1.2.3.4"), ("'8.8.8.8'", "8.8.8.8"), ("-", None), ("unknown", None), ("1.2.3", None), ("256.1.1.1", None), ("1:2:3", None), ("g::1", None), ("", None), (None, None)])
def test_ip_forms(spark, raw, want):
    assert one(spark, raw, net.normalize_ip) == want


@pytest.mark.parametrize("raw,want", [("1704067200", 1704067200), ("1704067200500", 1704067200), ("2024-01-01T08:00:00+08:00", 1704067200), ("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01 08:00:00", 1704067200),
                                      ("01/Jan/2024:01:00:00 +0100", 1704067200), ("Jan  1 08:00:00", 1704067200), ("yesterday", None), ("", None)])
def test_timestamps(spark, raw, want):
    assert one(spark, raw, lambda c: F.unix_seconds(normalize_timestamp(c, "+08:00", 2024))) == want


@pytest.mark.parametrize("rule,want", [("redact", "[REDACTED]"), ("truncate_3", "138…"), ({"method": "partial", "keep_start": 20}, "13812345678"), ("phone", "138****5678"), ({"method": "regex_replace"}, "13812345678"), ("nothing", "13812345678")])
def test_masks(spark, rule, want):
    assert one(spark, "13812345678", lambda c: X.mask(c, rule)) == want


def test_mask_keeps_null(spark):
    assert one(spark, None, lambda c: X.mask(c, "redact")) is None


def test_hmac(spark):
    for key in (b"k", b"x" * 80):
        assert one(spark, "body", lambda c: X.hmac_sha256(key, c)) == hmac.new(key, b"body", hashlib.sha256).hexdigest()


def test_kv(spark):
    assert one(spark, r'type=PATH name=2F746D70 a="x \"y\" z" a=2 junk =bad', X.parse_kv) == {"type": "PATH", "name": "/tmp", "a": "2"}
    assert one(spark, "type=SYSCALL a0=6C73", X.parse_kv)["a0"] == "6C73"
    assert one(spark, 'type=EXECVE a0="6C73" a1=6C73', X.parse_kv) == {"type": "EXECVE", "a0": "6C73", "a1": "ls"}
    assert one(spark, 'type=PROCTITLE proctitle="ls"', X.parse_kv)["proctitle"] == "6c73"


@pytest.mark.parametrize("raw,text,encoding", [("aGVsbG8gd29ybGQ=", "hello world", "base64"), ("data:text/plain;base64,aGVsbG8gd29ybGQ", "hello world", "data_uri_base64"), ('{"a":1}', None, "plain"), ("short", None, "plain"), ("not base 64!!", None, "plain")])
def test_base64(spark, raw, text, encoding):
    r = one(spark, raw, X.decode_base64)
    assert (r.text, r.encoding) == (text, encoding)


def test_urls(spark):
    assert one(spark, "GET /a%2520b?x=1#f HTTP/1.1", lambda c: web.decoded_text(web.path_query(c))) == "/a b?x=1#f"
    assert one(spark, "http://h?q=1", lambda c: web.path_query(c)) == "/?q=1"
    assert one(spark, "//h/x", lambda c: web.path_query(c)) == "/x"
    same = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(web.urls_correlate(F.col("a"), F.col("b"))).first()[0]
    assert same("http://h/Login?a=1", "/login") and not same("/a", "/b") and not same("", "/a")
    assert same("?user=admin&pass=secret", "?pass=secret&user=admin")


def test_ssh_targets_and_redaction(spark):
    from huntspark.operators.normalize import ssh_targets

    got = one(spark, "sshpass -p x ssh root@10.0.0.5; ssh 10.0.0.999; scp a 10.0.0.7:/", ssh_targets)
    assert ("root", "10.0.0.5") in [(r.user, r.ip) for r in got] and all(r.ip != "10.0.0.999" for r in got)
    assert one(spark, "x --token abc https://u:pw@h", X.redact_command) == "x --token [REDACTED] https://u:[REDACTED]@h"
    argv = spark.range(1).select(X.redact_argv(F.array(*[F.lit(a) for a in ("/usr/bin/sshpass", "-p", "pw", "ssh")]))).first()[0]
    assert argv == ["/usr/bin/sshpass", "-p", "[REDACTED]", "ssh"]


def test_named_groups(spark):
    assert one(spark, "GET /x 200 more", lambda c: X.named_groups(c, r"(?P<m>\w+) (?P<u>\S+) (?P<s>\d+)?")) == {"m": "GET", "u": "/x", "s": "200"}
    assert one(spark, "nothing", lambda c: X.named_groups(c, r"(?P<m>\d+)")) is None


def test_argv(spark):
    from huntspark.functions.argv import split_argv

    got = [r[0] for r in spark.createDataFrame([("a 'b c' d",), ('["x", "y z"]',), ("bad 'quote",), (None,)], "v string").select(split_argv("v")).collect()]
    assert got == [["a", "b c", "d"], ["x", "y z"], ["bad", "'quote"], None]


def test_plugin_connector(spark):
    from huntspark.sources.plugin import register_connector

    register_connector(spark, "demo_logs", "host string, n int", lambda o: range(int(o["slices"])), lambda o, p: [(f"h{p}", i) for i in range(p)])
    df = spark.read.format("demo_logs").option("slices", "4").load()
    assert df.rdd.getNumPartitions() == 4 and sorted(map(tuple, df.collect())) == [("h1", 0), ("h2", 0), ("h2", 1), ("h3", 0), ("h3", 1), ("h3", 2)]
