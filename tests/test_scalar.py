import base64
import hashlib
import ipaddress
import math
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import scalar


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in (values or {"x": 1}).items()))
    return df.select(column.alias("r")).first().r


def entropy(text):
    n = len(text)
    return round(-sum(c / n * math.log2(c / n) for c in Counter(text).values()), 4) + 0.0 if n else 0.0


def test_entropy_is_that_of_characters(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=30), min_size=40, max_size=80))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", scalar.shannon_entropy("x").alias("h"))
        for r in df.collect():
            assert r.h == pytest.approx(entropy(r.x), abs=1.01e-4)

    check()
    assert one(spark, scalar.entropy_of_array(F.sequence(F.lit(1), F.lit(64)))) == pytest.approx(6.0)
    assert one(spark, scalar.shannon_entropy("x"), x=None) == 0


@pytest.mark.parametrize("ip,external", [("203.0.113.88", True), ("8.8.8.8", True), ("192.168.1.1", False), ("10.0.0.5", False), ("172.16.0.1", False), ("172.32.0.1", True), ("127.0.0.1", False), ("0.0.0.0", False), ("224.0.0.1", False), ("bad", False), ("999.1.1.1", False), (None, False), ("2a00:1450::1", True), ("fe80::1", False), ("fd00::1", False), ("::1", False)])
def test_external_addresses(spark, ip, external):
    assert one(spark, scalar.is_external_ip("x"), x=ip) is external


@pytest.mark.parametrize("ip,net", [("192.168.1.50", "192.168.1.0/24"), ("10.240.15.205", "10.240.15.0/24"), ("2001:db8:85a3::1", "2001:db8:85a3::/48"), ("", "0.0.0.0/24"), (None, "0.0.0.0/24"), ("host", "host/24"), ("fe80::1", "fe80::/48"), ("2001:db8::5", "2001:db8::/48"), ("::1", "::/48")])
def test_subnets(spark, ip, net):
    assert one(spark, scalar.subnet("x"), x=ip) == net
    if ip and ":" in ip:
        assert ipaddress.ip_network(net) == ipaddress.ip_network(ip + "/48", strict=False)


@pytest.mark.parametrize("domain,low,high", [(d, 0.8, 1) for d in ("x8f93kdmw02.com", "pqzxwertyuiop.biz", "zklmptqwx9876.net", "a1b2c3d4e5f6g7.cc", "vbnmqlkjhgfdsaz.org")] + [(d, 0, 0.25) for d in ("google.com", "youtube.com", "wikipedia.org", "microsoft.com", "github.com", "amazon.com", "mail.google.com", "assets.netflix.com")] + [("ab.com", 0.05, 0.05), ("", 0.05, 0.05)])
def test_domain_scores(spark, domain, low, high):
    assert low <= one(spark, scalar.dga_score("x"), x=domain) <= high


def test_casts_and_defaults(spark):
    for value, number, whole in (("-", 0.0, 0), (None, 0.0, 0), ("12.5", 12.5, 0), ("7", 7.0, 7), ("x", 0.0, 0), (" 3 ", 3.0, 3), ("-4", -4.0, -4)):
        assert one(spark, scalar.safe_float("x"), x=value) == number
        assert one(spark, scalar.safe_int("x"), x=value) == whole
    assert one(spark, scalar.safe_str("x", "d"), x="-") == "d"
    assert one(spark, scalar.first_given("x", "y"), x="", y="b") == "b"


def test_times(spark):
    for value, seconds in (("1725000000.5", 1725000000.5), ("2024-08-30T06:40:00Z", 1725000000.0), ("2024-08-30T06:40:00.250", 1725000000.25), ("2024-08-30T08:40:00+02:00", 1725000000.0), ("never", None), (None, None)):
        assert one(spark, scalar.normalized_time("x"), x=value) == seconds
    assert one(spark, scalar.iso_time(F.col("x")), x=1725000000.0) == "2024-08-30T06:40:00Z"


def test_fingerprints_and_names(spark):
    made = one(spark, scalar.fingerprint(F.col("a"), F.col("b"), F.col("p"), F.lit("tcp"), F.lit("port_scan"), F.lit("d")), a="1.2.3.4", b=None, p=80)
    assert made == hashlib.sha256(b"1.2.3.4:ANY:80:TCP:PORT_SCAN:d").hexdigest()[:32]
    assert one(spark, scalar.wildcard_mask("x"), x="10.0.0.0/20") == "0.0.15.255"
    assert one(spark, scalar.rpz_name("x"), x="1.2.3.4") == "32.4.3.2.1.rpz-ip"
    assert one(spark, scalar.subdomain("x"), x="..a.b.") == "a"
    tokens = one(spark, scalar.domain_tokens("x"), x="A0é.")
    assert tokens[:4] == [2, 28, 1, 0] and len(tokens) == 75
    assert one(spark, scalar.human_bytes(F.col("x")), x=1536.0) == "1.50 KB" and one(spark, scalar.human_bps(F.col("x")), x=2500.0) == "2.50 Gbps"


def test_community_id_is_the_same_both_ways(spark):
    there = scalar.community_id(F.lit("128.232.110.120"), F.lit(34855), F.lit("66.35.250.204"), F.lit(80), F.lit("tcp"))
    back = scalar.community_id(F.lit("66.35.250.204"), F.lit(80), F.lit("128.232.110.120"), F.lit(34855), F.lit("tcp"))
    assert one(spark, there) == one(spark, back) == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="


def test_community_id_of_v6_flows(spark):
    ends = [("fe80::200:86ff:fe05:80da", 135), ("FE80:0:0:0:260:97ff:fe07:69ea", 134)]
    for (a, p), (b, q) in (ends, ends[::-1]):
        low, high = sorted((ipaddress.ip_address(x).packed, y) for x, y in ends)
        body = b"\0\0" + low[0] + high[0] + b"\x11\0" + struct.pack(">HH", low[1], high[1])
        want = "1:" + base64.b64encode(hashlib.sha1(body).digest()).decode()
        assert one(spark, scalar.community_id(F.lit(a), F.lit(p), F.lit(b), F.lit(q), F.lit("udp"))) == want
    assert one(spark, scalar.community_id(F.lit("none"), F.lit(1), F.lit("::1"), F.lit(2), F.lit("tcp"))) is None


@pytest.mark.parametrize("key", ["10.0.0.1", "", "fe80::1", "a" * 300])
def test_partitions_are_those_of_crc32(spark, key):
    assert one(spark, scalar.partition_of(F.lit(key), 4)) == zlib.crc32(key.encode()) % 4


def test_tls_codes(spark):
    for high in range(16):
        assert one(spark, scalar.is_grease(F.lit(high * 0x1010 + 0x0A0A if high * 16 + 10 < 256 else 0x0A0A)))
    assert not one(spark, scalar.is_grease(F.lit(0x1301)))
    ja4 = scalar.ja4(F.lit("t"), F.lit(0x0304), F.lit("x"), F.array().cast("array<int>"), F.array(F.lit(0), F.lit(16)), F.lit(""))
    assert one(spark, ja4) == "t13d000200_000000000000_000000000000"


def test_sql_functions(spark):
    scalar.register(spark)
    assert spark.sql("SELECT tw_entropy('aabb'), tw_subnet24('1.2.3.4'), tw_severity_rank('high')").first()[:] == (1.0, "1.2.3.0/24", 3)


def test_numbers_are_written_as_in_sql(spark):
    numbers = [0.0, -0.0, 1.0, -2.5, 0.001, 1e-4, 0.00012345, 9.999999999e-4, 1e-5, 1.25e-7, 1e-10, 9_999_999.0, 1e7, -15_118_968.0, 12_345_678.25, 123456789012345.67, 9_999_999_999_999_998.0, 1e16, -1.5e16, 1e300, 1e-300, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r.t for r in df.select("i", scalar.number_text(F.col("x")).alias("t")).orderBy("i").collect()]
    sql = duckdb.connect()
    assert got == [sql.execute("SELECT CAST(CAST(? AS DOUBLE) AS VARCHAR)", [x]).fetchall()[0][0] for x in numbers]
