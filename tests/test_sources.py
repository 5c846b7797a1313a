import json
import struct
import time

from pyspark.sql import functions as F

from tidewatch.operators import cep, detect
from tidewatch.sources import logs, pcap, scenarios
from tidewatch.streaming import jobs
from tidewatch.streaming.processors import Beacons, Cooldown, ScanCounts, TokenBucket, keyed


def write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


CONN = [
    "# comment", "", "{broken", '{"ts": 1725000000.25, "uid": "C1", "id.orig_h": "10.0.0.1", "id.orig_p": 5, "id.resp_h": "8.8.8.8", "id.resp_p": 443, "orig_bytes": "-", "resp_bytes": -5, "proto": "TCP"}',
    '{"ts": "2024-08-30T06:40:01Z", "uid": "C2", "src_ip": "10.0.0.2", "dst_ip": "8.8.4.4", "dst_port": "65535", "orig_bytes": "77"}',
    '{"ts": "2024-08-30T06:40:02Z", "uid": "C3", "source_ip": "10.0.0.3", "dst_port": 65536}', '{"uid": "C4"}',
]
DNS = ['{"ts": 1, "uid": "D1", "query": "a.b.c", "answers": "1.1.1.1", "TTLs": [5, "x"], "qtype_name": "txt"}', '{"ts": 2, "uid": "D2", "query": "-", "answers": ["-", "2.2.2.2"], "ttls": 7}']
SSL = ['{"ts": 1, "uid": "S1", "established": "T", "server_name": "x.y"}', '{"ts": 1, "uid": "S2", "established": "no", "version": "TLSv12"}']


def test_logs(spark, tmp_path):
    write(tmp_path, "conn.log", CONN)
    write(tmp_path, "dns.log", DNS)
    write(tmp_path, "ssl.log", SSL)
    got = logs.all_logs(spark, str(tmp_path))
    conn = {r.uid: r for r in got["conn"].collect()}
    assert set(conn) == {"C1", "C2", "C3", "C4"}
    assert (conn["C1"].ts, conn["C1"].orig_bytes, conn["C1"].resp_bytes, conn["C1"].proto, conn["C1"].conn_state) == (1725000000.25, 0, 0, "tcp", "SF")
    assert (conn["C2"].src_ip, conn["C2"].dst_port, conn["C2"].orig_bytes, conn["C2"].ts) == ("10.0.0.2", 65535, 77, 1725000001.0)
    assert [conn[f"C{i}"].quarantined for i in (1, 2, 3, 4)] == [False, False, True, True]
    dns = {r.uid: r for r in got["dns"].collect()}
    assert (list(dns["D1"].answers), list(dns["D1"].ttls), dns["D1"].subdomain, dns["D1"].qtype_name, dns["D1"].dst_port) == (["1.1.1.1"], [5.0, 0.0], "a", "TXT", 53)
    assert (dns["D2"].query, list(dns["D2"].answers), list(dns["D2"].ttls)) == ("", ["2.2.2.2"], [7.0])
    ssl = {r.uid: r for r in got["ssl"].collect()}
    assert ssl["S1"].established and not ssl["S2"].established and ssl["S1"].version == "TLSv13" and ssl["S2"].dst_port == 443


def test_stream_of_logs_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "conn.log", CONN)
    df = jobs.records(spark, str(tmp_path / "in"), "conn")
    jobs.write_parquet(df, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = logs.normalize("conn", logs.read_lines(spark, str(tmp_path / "in"))).where("not quarantined")
    assert sorted(r.uid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.uid for r in batch.collect()) == ["C1", "C2"]


def test_partitioned_store_and_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "conn.log", CONN)
    df = logs.normalize("conn", logs.read_lines(spark, str(tmp_path / "in"))).where("not quarantined")
    logs.append_partitioned(df, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.where("date = '2024-08-30' and hour = 6").count() == 2
    assert logs.expired(spark, str(tmp_path / "store"), "2024-08-31") == [f"{tmp_path}/store/date=2024-08-30"]
    rows = spark.createDataFrame([("I1", 1), ("I2", 1)], "incident_id string, seq long")
    for _ in range(2):
        logs.upsert_incidents(spark, str(tmp_path / "inc"), rows, 7)
    assert spark.read.parquet(str(tmp_path / "inc")).count() == 2


def test_packets(spark, tmp_path):
    def packet(n):
        tcp = struct.pack(">HHIIBBHHH", 1000 + n, 80, 0, 0, 5 << 4, 2, 0, 0, 0)
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40, 0, 0, 64, 6, 0, bytes([10, 0, 0, n]), bytes([8, 8, 8, 8]))
        return b"\0" * 12 + b"\x08\x00" + ip + tcp

    for order in "<>":
        body = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        for n in range(3):
            p = packet(n)
            body += struct.pack(order + "IIII", 100 + n, 500_000, len(p), len(p)) + p
        (tmp_path / f"x{'l' if order == '<' else 'b'}.pcap").write_bytes(body + b"\0" * 7)
    (tmp_path / "bad.pcap").write_bytes(b"nonsense")
    got = pcap.read_pcap(spark, str(tmp_path)).orderBy("path", "number").collect()
    assert len(got) == 6 and (got[1].src_ip, got[1].src_port, got[1].dst_port, got[1].ts, got[1].tcp_flags, got[1].proto) == ("10.0.0.1", 1001, 80, 101.5, 2, "tcp")


def test_connections_of_packets(spark):
    a, b, c = ("10.0.0.1", 1000), ("8.8.8.8", 80), ("10.0.0.2", 53)
    rows = [(a, b, 0.0, 60, 2), (b, a, 0.1, 60, 18), (a, b, 0.2, 500, 16), (b, a, 1.0, 700, 16), (a, b, 100.0, 60, 2), (b, a, 100.5, 40, 20), (c, b, 3.0, 60, 2)]
    packets = spark.createDataFrame([("x", n, float(t), *s, *d, "tcp", size, flags) for n, (s, d, t, size, flags) in enumerate(rows)] + [("x", 9, 5.0, *b, *c, "udp", 90, 0)], pcap.FIELDS)
    got = pcap.connections(packets).orderBy("us").collect()
    assert [(r.src_ip, r.dst_port, r.proto, round(r.duration, 3), r.orig_bytes, r.resp_bytes, r.orig_pkts, r.resp_pkts, r.conn_state) for r in got] == [
        ("10.0.0.1", 80, "tcp", 1.0, 560, 760, 2, 2, "SF"),
        ("10.0.0.2", 80, "tcp", 0.0, 60, 0, 1, 0, "S0"),
        ("8.8.8.8", 53, "udp", 0.0, 90, 0, 1, 0, "S0"),
        ("10.0.0.1", 80, "tcp", 0.5, 60, 40, 1, 1, "REJ"),
    ]
    assert len({r.uid for r in got}) == 4 and pcap.connections(packets.where("false")).count() == 0


def test_keyed_state_equals_batch(spark):
    alerts = spark.createDataFrame([(i, i * 30_000, f"10.0.0.{i % 3}") for i in range(200)], "event_id long, us long, source_ip string")
    a = {(r.source_ip, r.event_id, r.allowed) for r in keyed(alerts, "source_ip", TokenBucket()).collect()}
    b = {(r.source_ip, r.event_id, r.allowed) for r in cep.token_bucket(alerts).select("source_ip", "event_id", "allowed").collect()}
    assert a == b and {x[2] for x in a} == {True, False}
    conn = scenarios.port_scan(spark, 40).unionByName(scenarios.benign_web(spark).withColumn("event_id", F.col("event_id") + 1000))
    counts = ["src_ip", "event_id", "ports", "hosts", "endpoints", "failed", "failure_ratio"]
    assert sorted(keyed(conn, "src_ip", ScanCounts()).select(counts).collect()) == sorted(detect.scan_counts(conn).select(counts).collect())
    cool = {r.event_id for r in keyed(alerts.withColumnRenamed("source_ip", "k"), "k", Cooldown(5.0)).collect()}
    assert cool == {r.event_id for r in detect.cooled(alerts.withColumnRenamed("source_ip", "k"), ["k"], 5.0).collect()}
    pairs = scenarios.beacon(spark).withColumn("pair", F.lit("p"))
    assert sorted((r.event_id, r.n_gaps, r.mean, r.cv) for r in keyed(pairs, "pair", Beacons()).collect()) == sorted((r.event_id, r.n_gaps, r["mean"], r.cv) for r in detect.interval_stats(pairs, ["pair"]).collect())


def test_stream_keeps_state_between_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"event_id": i, "us": i * 90_000, "source_ip": "10.0.0.1"} for i in range(60)]
    schema = "event_id long, us long, source_ip string"
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[:25], rows[25:]):
        (tmp_path / "in" / f"{part[0]['event_id']}.json").write_text("\n".join(map(json.dumps, part)))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        jobs.write_parquet(keyed(stream, "source_ip", TokenBucket()), out, check).awaitTermination()
    got = {(r.event_id, r.allowed) for r in spark.read.parquet(out).collect()}
    want = {(r.event_id, r.allowed) for r in cep.token_bucket(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()}
    assert got == want


def test_session_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "us long, source_ip string, target_ip string, target_port int, protocol string, threat_class string, detector_name string, severity string, confidence double"
    base = {"source_ip": "a", "target_ip": "b", "target_port": 1, "protocol": "tcp", "threat_class": "t", "detector_name": "d", "severity": "LOW", "confidence": 0.5}
    times = (0, 3_000_000, 7_000_000, 20_000_000, 900_000_000)
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(base | {"us": u}) for u in times))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_micros("us"))
    got = []
    jobs.for_each(jobs.session_alerts(stream), lambda df, n: got.extend(df.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.occurrence_count for r in got) == [1, 3]


def test_the_state_of_a_silent_key_ends(spark, tmp_path):
    source, schema, seen = str(tmp_path / "in"), "k string, us long, event_id long", set()

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def wait_for(n):
        until = time.monotonic() + 60
        while n not in seen and time.monotonic() < until:
            time.sleep(0.5)

    put([("a", 1, 1), ("a", 2, 2)])
    stream = keyed(spark.readStream.schema(schema).parquet(source), "k", Cooldown(1000.0), ttl=2)
    running = stream.writeStream.foreachBatch(lambda df, _: seen.update(r.event_id for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        wait_for(1)
        time.sleep(4)
        # The gap hasn't passed by the rows' own times, but nothing is known of the key any more.
        put([("a", 3, 3), ("a", 4, 4)])
        wait_for(3)
    finally:
        running.stop()
    assert seen == {1, 3}
