"""Scalar functions on columns, built from built-in functions only, so that they stay in the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed


def either(values: dict) -> Column:
    """A map literal."""
    return F.create_map(*map(F.lit, chain(*values.items())))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entropy_of_array(items: Column) -> Column:
    """Shannon entropy, in bits, of the items' distribution; 0 for none. log2 n - sum(c log2 c) / n.

    Equal items are counted as runs of the sorted array, so the cost is that of a sort.
    """
    n = F.size(items).cast("double")
    start = F.struct(F.get(items, 0).alias("x"), F.lit(0.0).alias("run"), F.lit(0.0).alias("s"))

    def step(a: Column, x: Column) -> Column:
        same = x.eqNullSafe(a["x"])
        return F.struct(x.alias("x"), F.when(same, a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, a["s"]).otherwise(a["s"] + _c_log_c(a["run"])).alias("s"))

    folded = F.aggregate(F.array_sort(items), start, step, lambda a: a["s"] + _c_log_c(a["run"]))
    return F.when(n > 0, F.log2(n) - folded / n).otherwise(F.lit(0.0))


def _c_log_c(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def characters(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), ""), lambda c: c != "")


def shannon_entropy(text: Column | str) -> Column:
    """Entropy of the text's characters, to 4 places; 0 for null and empty texts."""
    return F.round(F.coalesce(entropy_of_array(characters(text)), F.lit(0.0)), 4)


def subdomain(query: Column | str) -> Column:
    """The leftmost label that isn't empty; null where there is none."""
    labels = F.filter(F.split(F.trim(_col(query)), r"\."), lambda x: x != "")
    return F.when(F.size(labels) > 0, F.element_at(labels, 1))


def safe_float(value: Column | str, default: float | None = 0.0) -> Column:
    """A number, or the default for null, '-' and what isn't one."""
    return F.coalesce(F.nullif(F.trim(_col(value)), F.lit("-")).try_cast("double"), F.lit(default).cast("double"))


def safe_int(value: Column | str, default: int | None = 0) -> Column:
    text = F.nullif(F.trim(_col(value)), F.lit("-"))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(whole, F.lit(default).cast("bigint"))


def safe_str(value: Column | str, default: str | None = None) -> Column:
    text = _col(value).cast("string")
    return F.when(text.isNull() | (text == "-"), F.lit(default).cast("string")).otherwise(text)


def first_given(*values: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_col(v), F.lit("")) for v in values))


def is_v4(ip: Column | str) -> Column:
    return _col(ip).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def octets(ip: Column | str) -> Column:
    return F.transform(F.split(_col(ip), r"\."), lambda x: x.try_cast("int"))


def is_external_ip(ip: Column | str) -> Column:
    """Whether a v4 address is outside the private, loopback, link-local, multicast and reserved ranges; v6 likewise by its first digits; false for what is no address."""
    ip = F.trim(_col(ip))
    o = octets(ip)
    inner = ip.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.)") | ((o[0] == 172) & o[1].between(16, 31)) | o[0].between(224, 255)
    v4 = is_v4(ip) & (F.array_max(o) <= 255)
    low = F.lower(ip)
    v6 = low.contains(":") & low.rlike(r"^[0-9a-f:.]+$")
    v6_inner = low.isin("::", "::1") | low.rlike(r"^(f[cd]|fe[89ab]|ff)[0-9a-f]{0,2}:") | low.startswith("2001:db8:")
    return F.coalesce(F.when(v4, ~inner).when(v6, ~v6_inner).otherwise(F.lit(False)), F.lit(False))


def v6_groups(ip: Column) -> Column:
    """The eight groups of a v6 address as numbers in hex, :: filled up with zeros."""
    low = F.lower(ip)
    halves = F.split(low, "::", 2)
    groups = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")
    head, tail = groups(halves[0]), F.when(F.size(halves) > 1, groups(halves[1])).otherwise(F.array().cast("array<string>"))
    return F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(head) - F.size(tail))), tail)


def subnet(ip: Column | str) -> Column:
    """The /24 of a v4 address or the /48 of a v6 one; 0.0.0.0/24 for none, ip/24 for what is no address."""
    ip = F.trim(_col(ip))
    v4 = is_v4(ip) & (F.array_max(octets(ip)) <= 255)
    groups = F.transform(F.slice(v6_groups(ip), 1, 3), lambda x: F.lower(F.conv(x, 16, 16)))
    kept = F.when(groups[2] != "0", 3).when(groups[1] != "0", 2).when(groups[0] != "0", 1).otherwise(0)
    v6 = F.concat(F.array_join(F.slice(groups, 1, kept), ":"), F.lit("::/48"))
    return F.when(ip.isNull() | (ip == ""), "0.0.0.0/24").when(v4, F.concat(F.array_join(F.transform(F.slice(octets(ip), 1, 3), lambda x: x.cast("string")), "."), F.lit(".0/24"))).when(ip.rlike(r"^[0-9A-Fa-f:]+$") & ip.contains(":"), v6).otherwise(F.concat(ip, F.lit("/24")))


def ip_number(ip: Column | str) -> Column:
    """A v4 address as a long; null for others."""
    o = octets(ip)
    return F.when(is_v4(ip), o[0].cast("long") * 16777216 + o[1] * 65536 + o[2] * 256 + o[3])


def wildcard_mask(cidr: Column | str) -> Column:
    """The inverted mask of a v4 CIDR: /24 gives 0.0.0.255; no prefix counts as /32."""
    bits = F.lit(32) - F.coalesce(F.try_element_at(F.split(_col(cidr), "/"), F.lit(2)).try_cast("int"), F.lit(32))
    octet = lambda k: F.greatest(F.lit(0), F.least(F.lit(8), bits - 8 * k))
    return F.concat_ws(".", *((F.pow(F.lit(2.0), octet(k)) - 1).cast("int").cast("string") for k in (3, 2, 1, 0)))


def rpz_name(ip: Column | str) -> Column:
    """The name of a v4 address in a response policy zone: /32, then octets in reverse."""
    return F.concat(F.lit("32."), F.array_join(F.reverse(F.split(_col(ip), r"\.")), "."), F.lit(".rpz-ip"))


def fingerprint(source: Column, target: Column, port: Column, protocol: Column, threat: Column, detector: Column) -> Column:
    """What makes alerts the same: half of a SHA-256 of the key's parts, in hex."""
    or_any = lambda c, other: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(other))
    key = F.concat_ws(":", or_any(source, "0.0.0.0"), or_any(target, "ANY"), or_any(port, "0"), F.upper(or_any(protocol, "ANY")), F.upper(or_any(threat, "UNKNOWN")), or_any(detector, "unknown"))
    return F.substring(F.sha2(key, 256), 1, 32)


def is_grease(code: Column) -> Column:
    """Whether a TLS code is a reserved one: both bytes alike, with a low half of A."""
    high, low = F.shiftright(code, 8), code.bitwiseAND(255)
    return (high == low) & (low.bitwiseAND(15) == 10)


def short_hash(text: Column) -> Column:
    """The first 12 hex digits of a SHA-256; zeros for an empty text."""
    return F.when(F.length(text) > 0, F.substring(F.sha2(text, 256), 1, 12)).otherwise(F.lit("0" * 12))


TLS_VERSION = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2", 0xFEFF: "d1", 0xFEFD: "d2", 0xFEFC: "d3"}


def tls_version_code(version: Column) -> Column:
    return F.coalesce(F.try_element_at(either(TLS_VERSION), version.cast("int")), F.lit("00"))


def _hex_codes(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 4, "0")))


def _alpn_code(alpn: Column) -> Column:
    return F.when(F.length(alpn) > 0, F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1))).otherwise(F.lit("00"))


def _two(n: Column) -> Column:
    return F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")


def ja4(transport: Column, version: Column, sni: Column, ciphers: Column, extensions: Column, alpn: Column) -> Column:
    """The client fingerprint of a TLS hello: transport, version, SNI, counts, ALPN, and hashes of sorted ciphers and of sorted extensions without 0 (SNI) and 16 (ALPN). Reserved codes don't count."""
    c, e = F.filter(ciphers, lambda x: ~is_grease(x)), F.filter(extensions, lambda x: ~is_grease(x))
    part_a = F.concat(transport, tls_version_code(version), F.when(F.length(sni) > 0, "d").otherwise("i"), _two(F.size(c)), _two(F.size(e)), _alpn_code(alpn))
    hashed = lambda xs: short_hash(F.array_join(F.array_sort(_hex_codes(xs)), ","))
    return F.concat_ws("_", part_a, hashed(c), hashed(F.filter(e, lambda x: ~x.isin(0, 16))))


def ja4s(transport: Column, version: Column, cipher: Column, extensions: Column, alpn: Column) -> Column:
    """The server fingerprint: transport, version, extension count, ALPN, the chosen cipher, and a hash of extensions in their order without 16."""
    e = F.filter(extensions, lambda x: ~is_grease(x))
    part_a = F.concat(transport, tls_version_code(version), _two(F.size(e)), _alpn_code(alpn))
    return F.concat_ws("_", part_a, F.lower(F.lpad(F.hex(cipher), 4, "0")), short_hash(F.array_join(_hex_codes(F.filter(e, lambda x: x != 16)), ",")))


def domain_tokens(domain: Column | str, length: int = 75) -> Column:
    """Symbol numbers of a domain, cut and padded to one length."""
    clean = F.btrim(F.btrim(F.lower(_col(domain))), F.lit("."))
    number = either({c: n for n, c in enumerate(fixed.DOMAIN_SYMBOLS, 2)})
    known = F.transform(F.slice(characters(clean), 1, length), lambda c: F.coalesce(F.try_element_at(number, c), F.lit(1)))
    return F.concat(known, F.array_repeat(F.lit(0), F.lit(length) - F.size(known))).cast("array<bigint>")


def _ends_in_domain(name: Column, domains: list[str]) -> Column:
    """Whether a name is one of the domains or below one: its last 1, 2 or 3 labels are looked up."""
    labels = F.split(name, r"\.")
    most = max(d.count(".") + 1 for d in domains)
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    return F.arrays_overlap(tails, F.array(*map(F.lit, domains)))


def is_benign_domain(name: Column | str) -> Column:
    return _ends_in_domain(_col(name), fixed.BENIGN_DOMAINS)


def domain_label(domain: Column | str) -> Column:
    """The label that a domain score looks at: the one before a common top-level domain, else the first."""
    labels = F.split(F.btrim(F.btrim(F.lower(_col(domain))), F.lit(".")), r"\.")
    common = (F.size(labels) >= 2) & F.element_at(labels, -1).isin(fixed.SCORE_TLDS)
    return F.when(common, F.get(labels, F.size(labels) - 2)).otherwise(labels[0])


def _score_parts(label: Column) -> dict[str, Column]:
    """What a domain score looks at in a label."""
    n = F.length(label)
    runs = F.regexp_extract_all(label, F.lit("[b-df-hj-np-tv-z]+"), F.lit(0))
    return {
        "n": n,
        "vowels": F.regexp_count(label, F.lit("[aeiou]")) / n,
        "n_digits": F.regexp_count(label, F.lit("[0-9]")),
        "streak": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
        "entropy": shannon_entropy(label),
        "pairs": F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(label, i, F.lit(2))),
    }


def _score(p: dict[str, Column], label: Column, benign: Column) -> Column:
    n, entropy, streak, vowels, pairs = p["n"], p["entropy"], p["streak"], p["vowels"], p["pairs"]
    changes = F.size(F.filter(pairs, lambda x: x.rlike("^([a-z][0-9]|[0-9][a-z])$"))) / F.greatest(F.lit(1), n - 1)
    parts = (
        F.when(entropy >= 3.8, 0.40).when(entropy >= 3.2, 0.25).when(entropy < 2.2, -0.30).otherwise(0.0),
        F.when(streak >= 6, 0.35).when(streak >= 4, 0.20).otherwise(0.0),
        F.when(vowels < 0.15, 0.25).when(vowels > 0.60, 0.15).otherwise(0.0),
        F.when((changes >= 0.25) & (p["n_digits"] >= 2), 0.30).otherwise(0.0),
        F.size(F.filter(pairs, lambda x: x.isin(fixed.RARE_BIGRAMS))) * 0.15,
        F.when((n >= 12) & ((vowels < 0.20) | (p["n_digits"] / n > 0.20)), 0.15).otherwise(0.0),
    )
    likely = 1.0 / (1.0 + F.exp(-3.5 * (sum(parts[1:], parts[0]) - 0.25)))
    likely = F.least(likely * F.when(benign, 0.15).otherwise(1.0), F.when(benign, 0.10).otherwise(1.0))
    return F.when(F.coalesce(n, F.lit(0)) < 3, 0.05).otherwise(F.round(F.least(F.lit(0.999), F.greatest(F.lit(0.001), likely)), 4))


def dga_score(domain: Column | str) -> Column:
    """How likely a domain is generated, 0.001 to 0.999: entropy, runs of consonants, vowels, letters next to digits and rare pairs, through a sigmoid; well-known names are damped."""
    clean = F.btrim(F.btrim(F.lower(_col(domain))), F.lit("."))
    label = domain_label(domain)
    return _score(_score_parts(label), label, _ends_in_domain(clean, fixed.SCORE_BENIGN_DOMAINS) | label.isin(fixed.SCORE_BENIGN_LABELS))


def with_dga_score(df: DataFrame, domain: str, name: str = "dga_prob") -> DataFrame:
    """df with dga_score of a column, in steps, so that what several parts need is computed once and plans stay small."""
    clean = F.btrim(F.btrim(F.lower(F.col(domain))), F.lit("."))
    out = df.withColumns({"_label": domain_label(domain), "_benign": _ends_in_domain(clean, fixed.SCORE_BENIGN_DOMAINS)})
    parts = _score_parts(F.col("_label"))
    out = out.withColumns({f"_{k}": c for k, c in parts.items()})
    score = _score({k: F.col(f"_{k}") for k in parts}, F.col("_label"), F.col("_benign") | F.col("_label").isin(fixed.SCORE_BENIGN_LABELS))
    return out.withColumn(name, score).drop("_label", "_benign", *(f"_{k}" for k in parts))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(either(fixed.SEVERITY_RANK), F.upper(severity)), F.lit(2))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, fixed.SEVERITY_RANK)), rank.cast("int"))


def fusion_stage(threat: Column, detector: Column) -> Column:
    stages = either(fixed.FUSION_STAGE)
    return F.coalesce(F.try_element_at(stages, F.upper(threat)), F.try_element_at(stages, F.lower(detector)), F.lit("RECONNAISSANCE"))


def asset_role(ip: Column | str) -> Column:
    ip = F.trim(_col(ip))
    out = F.when(ip.isNull() | ip.isin("", "0.0.0.0"), "INTERNAL_WORKSTATION")
    for end, role in fixed.ROLE_BY_SUFFIX:
        out = out.when(ip.endswith(end), role)
    return out.otherwise("INTERNAL_WORKSTATION")


def criticality(role: Column, explicit: Column | None = None) -> Column:
    """1 to 2, by an explicit value or the role."""
    by_role = F.coalesce(F.try_element_at(either(fixed.ROLE_CRITICALITY), F.upper(role)), F.lit(1.0))
    given = by_role if explicit is None else F.coalesce(explicit, by_role)
    return F.greatest(F.lit(1.0), F.least(F.lit(2.0), given))


def egress_ratio(out_bytes: Column, in_bytes: Column) -> Column:
    return out_bytes / (in_bytes + 1024.0)


def egress_mbps(out_bytes: Column, seconds: float = 60.0) -> Column:
    return out_bytes * 8 / (seconds * 1e6)


def snort_classtype(threat: Column) -> Column:
    """The class of a detection rule, by the first word that the threat's name holds."""
    t = F.upper(threat)
    by_word = (("DDOS", "attempted-dos"), ("RECON", "attempted-recon"), ("PORT_SCAN", "attempted-recon"), ("DGA", "trojan-activity"), ("MALWARE", "trojan-activity"), ("C2", "trojan-activity"), ("EXFIL", "policy-violation"), ("APT", "targeted-activity"))
    out = F.when(t.isNull(), "suspicious-login")
    for word, name in by_word:
        out = out.when(t.contains(word), name)
    return out.otherwise("suspicious-login")


def normalized_time(value: Column | str) -> Column:
    """Epoch seconds of a number, a numeric text or an ISO-8601 text (without a zone: UTC); null for others. Microseconds are kept."""
    text = F.trim(_col(value).cast("string"))
    iso = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(iso)) / 1e6)


def iso_time(seconds: Column) -> Column:
    """yyyy-mm-ddThh:mm:ssZ in UTC."""
    at = F.timestamp_seconds(seconds)
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capped(items: Column, most: int) -> Column:
    """The first `most` different items in order."""
    return F.slice(F.array_distinct(items), 1, most)


def matches_search(term: str, *fields: Column) -> Column:
    """Whether any field holds the term, in either case."""
    low = F.lit(term.lower())
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.lower(f.cast("string")).contains(low), F.lit(False))
    return out


def number_text(x: Column) -> Column:
    """A double as the SQL engines beside Spark write it: plain from 1e-4 up to 1e16 (Spark: from 1e-3 up to 1e7), else as 1.5e+16."""
    x, size = x.cast("double"), F.abs(x.cast("double"))
    said = x.cast("string")
    whole = F.concat(x.cast("long").cast("string"), F.lit(".0"))
    trimmed = lambda digits: F.rtrim(x.cast(f"decimal(38, {digits})").cast("string"), F.lit("0"))
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, r"\.0E", "E"), r"E(\d)", "e+$1"), r"E-(\d+)", "e-$1")
    short = F.regexp_replace(short, r"e-(\d)$", "e-0$1")
    large, small = (size >= 1e7) & (size < 1e16), (size >= 1e-4) & (size < 1e-3)
    # NaN is over all numbers here.
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(large, F.when(x == F.floor(x), whole).otherwise(trimmed(10))).when(small, trimmed(22)).otherwise(short)


def human_bytes(n: Column) -> Column:
    step = F.when(n >= 1, F.floor(F.log(n) / F.lit(6.931471805599453))).otherwise(F.lit(0)).cast("int")
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB", "PB")))
    step = F.least(step, F.lit(5))
    return F.concat(F.format_number(n / F.pow(F.lit(1024.0), step), 2), F.lit(" "), F.get(units, step))


def human_bps(mbps: Column) -> Column:
    return F.when(mbps >= 1000, F.concat(F.format_number(mbps / 1000, 2), F.lit(" Gbps"))).otherwise(F.concat(F.format_number(mbps, 2), F.lit(" Mbps")))


def human_latency(ms: Column) -> Column:
    return F.when(ms < 1, F.concat(F.format_number(ms * 1000, 1), F.lit(" us"))).when(ms < 1000, F.concat(F.format_number(ms, 1), F.lit(" ms"))).otherwise(F.concat(F.format_number(ms / 1000, 2), F.lit(" s")))


def relative_time(seconds: Column, now: Column) -> Column:
    """How long before `now`, in the largest fitting unit."""
    ago = F.greatest(F.lit(0), F.floor(now - seconds))
    return F.when(ago < 60, F.concat(ago.cast("string"), F.lit("s ago"))).when(ago < 3600, F.concat(F.floor(ago / 60).cast("string"), F.lit("m ago"))).when(ago < 86400, F.concat(F.floor(ago / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(ago / 86400).cast("string"), F.lit("d ago")))


def partition_of(key: Column, n: int) -> Column:
    """A partition number that equal keys share; an empty key, or n up to 1, gives 0."""
    if n <= 1:
        return F.lit(0)
    clean = F.trim(F.coalesce(key, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.pmod(F.crc32(clean), F.lit(n)).cast("int"))


def stix_id(kind: str, name: Column) -> Column:
    """A deterministic identifier: kind and a version-5 UUID's layout over a SHA-1 of the name."""
    h = F.sha1(F.concat(F.lit("tidewatch:" + kind + ":"), name))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.lit(kind + "--"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def ip_hex(ip: Column | str) -> Column:
    """An address as hex digits, 8 of a v4 one and 32 of a v6 one, in the order of its bytes; null for others."""
    ip = F.trim(_col(ip))
    v4 = is_v4(ip) & (F.array_max(octets(ip)) <= 255)
    groups = v6_groups(ip)
    v6 = ip.contains(":") & ip.rlike("^[0-9A-Fa-f:]+$") & (F.size(groups) == 8)
    return F.when(v4, F.lpad(F.lower(F.hex(ip_number(ip))), 8, "0")).when(v6, F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), ""))


def community_id(src: Column, src_port: Column, dst: Column, dst_port: Column, protocol: Column, seed: int = 0) -> Column:
    """Community ID v1 of a v4 or v6 flow: 1: and base64 of SHA-1 over seed, ordered ends, protocol number and ports; the same in both directions, and null for what is no address."""
    number = F.coalesce(F.try_element_at(either({"icmp": 1, "tcp": 6, "udp": 17, "icmp6": 58, "sctp": 132}), F.lower(protocol)), F.lit(0))
    a, b = ip_hex(src), ip_hex(dst)
    forward = (a < b) | ((a == b) & (src_port <= dst_port))
    hexed = lambda n, w: F.lpad(F.hex(n.cast("long")), w, "0")
    pick = lambda x, y: F.when(forward, x).otherwise(y)
    body = F.concat(F.lit(f"{seed:04x}"), pick(a, b), pick(b, a), hexed(number, 2), F.lit("00"), hexed(pick(src_port, dst_port), 4), hexed(pick(dst_port, src_port), 4))
    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(body)))))


def register(spark: SparkSession) -> None:
    """SQL names of functions that analysts use most."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tw_severity_rank(s STRING) RETURNS INT RETURN CASE upper(s) WHEN 'LOW' THEN 1 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 2 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tw_entropy(s STRING) RETURNS DOUBLE RETURN CASE WHEN length(s) > 0 THEN round(log2(length(s)) - aggregate(array_distinct(split(s, '')), 0D, (a, x) -> a + (length(s) - length(replace(s, x, ''))) * log2(length(s) - length(replace(s, x, '')))) / length(s), 4) ELSE 0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tw_subnet24(ip STRING) RETURNS STRING RETURN concat(substring_index(ip, '.', 3), '.0/24')")
