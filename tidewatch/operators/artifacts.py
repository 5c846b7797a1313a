"""Drafts of countermeasures as text, for people to review. Nothing here runs or sends anything, and every
draft says that it needs human approval. Input: triaged incidents (incident_id, source_ip, subnet,
target_ips, target_ports, threat_class, severity, risk_score, updated_us, domains, ja4, technique_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalar

NEEDS = "requires_human_approval: true"
SECOND = 1_000_000
SID_BASE = 9_700_000


def _c(name: str) -> Column:
    return F.col(name)


def _said(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _header(mark: str, kind: str) -> Column:
    return F.array(
        _said(mark, f" {kind} draft for incident ", _c("incident_id")),
        _said(mark, " as of ", scalar.iso_time(_c("updated_us") / SECOND), ", threat ", _c("threat_class"), ", severity ", _c("severity"), ", risk ", F.format_number("risk_score", 1), "/100"),
        F.lit(f"{mark} {NEEDS}. Review, approve and deploy by your change process; never apply automatically."),
    )


def _lines(*parts: Column) -> Column:
    return F.concat(F.array_join(F.flatten(F.array(*parts)), "\n"), F.lit("\n"))


def _each(items: str | Column, most: int, line) -> Column:
    return F.transform(F.slice(_c(items) if isinstance(items, str) else items, 1, most), line)


def _if(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast("array<string>"))


def _has_subnet() -> Column:
    return _c("subnet").contains("/") & (_c("subnet") != _c("source_ip"))


def _ports(most: int) -> Column:
    return F.array_join(F.transform(F.slice("target_ports", 1, most), lambda p: p.cast("string")), ",")


def iptables() -> Column:
    tag = _said(' -m comment --comment "', _c("incident_id"), '" -j DROP')
    source = F.array(*(_said(f"{tool} -I {chain} 1 -s ", _c("source_ip"), tag) for chain in ("INPUT", "FORWARD") for tool in ("iptables", "ip6tables")))
    net = F.array(*(_said(f"{tool} -I INPUT 2 -s ", _c("subnet"), tag) for tool in ("iptables", "ip6tables")))
    ports = F.array(*(_said(f"iptables -I INPUT 1 -p {p} -m multiport --dports ", _ports(15), " -s ", _c("source_ip"), " -j DROP") for p in ("tcp", "udp")))
    return _lines(_header("#", "iptables"), source, _if(_has_subnet(), net), _each("target_ips", 10, lambda t: _said("iptables -I OUTPUT 1 -d ", t, tag)), _if(F.size("target_ports") > 0, ports))


def nftables() -> Column:
    sources = F.when(_has_subnet(), _said(_c("source_ip"), ", ", _c("subnet"))).otherwise(_c("source_ip"))
    body = F.array(
        F.lit("add table inet review"),
        _said("add set inet review blocked { type ipv4_addr; flags interval; elements = { ", sources, " } }"),
        F.lit("add chain inet review input { type filter hook input priority 0; policy accept; }"),
        F.lit("add chain inet review forward { type filter hook forward priority 0; policy accept; }"),
        F.lit("add rule inet review input ip saddr @blocked drop"),
        F.lit("add rule inet review forward ip saddr @blocked drop"),
    )
    targets = F.array(
        _said("add set inet review targets { type ipv4_addr; flags interval; elements = { ", F.array_join(F.slice("target_ips", 1, 10), ", "), " } }"),
        F.lit("add chain inet review output { type filter hook output priority 0; policy accept; }"),
        F.lit("add rule inet review output ip daddr @targets drop"),
    )
    ports = F.array(*(_said("add rule inet review input ip saddr ", _c("source_ip"), f" {p} dport {{ ", _ports(15), " } drop") for p in ("tcp", "udp")))
    return _lines(_header("#", "nftables"), body, _if(F.size("target_ips") > 0, targets), _if(F.size("target_ports") > 0, ports))


def cisco_acl() -> Column:
    host = _c("source_ip")
    ports = F.flatten(_each("target_ports", 10, lambda p: F.array(*(_said(f"deny {proto} host ", host, " any eq ", p.cast("string"), " log") for proto in ("tcp", "udp")))))
    network = F.split(_c("subnet"), "/")[0]
    rules = F.flatten(F.array(
        F.array(_said("deny ip host ", host, " any log")),
        _if(_c("subnet").contains("/"), F.array(_said("deny ip ", network, " ", scalar.wildcard_mask("subnet"), " any log"))),
        ports,
        _each("target_ips", 5, lambda t: _said("deny ip any host ", t, " log")),
        F.array(F.lit("permit ip any any")),
    ))
    numbered = F.transform(rules, lambda r, i: _said(" ", ((i + 1) * 10).cast("string"), " ", r))
    return _lines(_header("!", "Cisco ACL"), F.array(_said("ip access-list extended REVIEW-", _c("incident_id")), F.lit(f" remark {NEEDS}")), numbered)


def dns_rpz() -> Column:
    stop = f" CNAME . ; {NEEDS}"
    names = F.flatten(_each("domains", 50, lambda d: F.array(_said(F.regexp_replace(d, r"\.+$", ""), stop), _said("*.", F.regexp_replace(d, r"\.+$", ""), stop))))
    addresses = F.concat(F.array(_c("source_ip")), F.slice("target_ips", 1, 10))
    return _lines(_header(";", "DNS response policy"), F.array(F.lit("$ORIGIN rpz.review.local."), F.lit("$TTL 300")), names, F.transform(addresses, lambda a: _said(scalar.rpz_name(a), stop)))


def snort_sid(incident: Column) -> Column:
    return F.pmod(F.crc32(incident), F.lit(100_000)) + SID_BASE


def snort() -> Column:
    sid, kind = snort_sid(_c("incident_id")), scalar.snort_classtype(_c("threat_class"))
    priority = F.when(_c("severity").isin("CRITICAL", "HIGH"), "1").when(_c("severity") == "MEDIUM", "2").otherwise("3")

    def rule(n: int, head, message, options, own_kind: Column = kind) -> Column:
        return _said("alert ", head, ' (msg:"', _c("incident_id"), " ", message, '"; ', options, "classtype:", own_kind, "; priority:", priority, "; sid:", (sid + n).cast("string"), '; rev:1; metadata: mitre_technique "', F.coalesce(_c("technique_id"), F.lit("T1595")), '", requires_human_approval "true";)')

    source = _said("[", _c("source_ip"), "]")
    targets = F.when(F.size("target_ips") > 0, _said("[", F.array_join(F.slice("target_ips", 1, 5), ","), "]")).otherwise("any")
    flood = F.upper(_c("threat_class")).rlike("DDOS|DENIAL")
    return _lines(
        _header("#", "Snort 3"),
        F.array(rule(0, _said("tcp ", source, " any -> any any"), _c("threat_class"), "flow:established; "), rule(1, _said("udp ", source, " any -> any any"), _c("threat_class"), "")),
        _if(F.size("target_ports") > 0, F.array(rule(2, _said("tcp ", source, " any -> ", targets, " [", _ports(10), "]"), "targeted ports", "flow:to_server,established; "))),
        _if(F.length("ja4") > 0, F.array(rule(3, "tls any any -> any any", "TLS fingerprint", _said('tls.ja4:"', _c("ja4"), '"; '), F.lit("trojan-activity")))),
        _if(flood, F.array(rule(4, _said("icmp ", source, " any -> any any"), "flood", "threshold:type both,track by_src,count 500,seconds 10; ", F.lit("attempted-dos")))),
    )


def stix() -> Column:
    """A STIX 2.1 bundle: identity, actor, technique, indicators of source, targets and domains, and their relations. Indicators are valid for 90 days from the incident's last event."""
    at, until = scalar.iso_time(_c("updated_us") / SECOND), scalar.iso_time(_c("updated_us") / SECOND + 90 * 86400)
    who, actor = scalar.stix_id("identity", F.lit("tidewatch")), scalar.stix_id("threat-actor", _c("source_ip"))
    technique = F.coalesce(_c("technique_id"), F.lit("T1595"))
    pattern = scalar.stix_id("attack-pattern", technique)

    def sdo(kind: str, ident: Column, name: Column, **more) -> Column:
        fields = {"type": F.lit(kind), "spec_version": F.lit("2.1"), "id": ident, "created": at, "modified": at, "name": name, "labels": F.array(F.lit("requires_human_approval")), **more}
        return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))

    def indicator(value: Column, path: str, share: float) -> Column:
        return sdo("indicator", scalar.stix_id("indicator", value), value, pattern=_said(f"[{path}:value = '", value, "']"), pattern_type=F.lit("stix"), valid_from=at, valid_until=until, confidence=F.least(F.lit(int(100 * share)), (F.col("risk_score") * share).cast("int")))

    def relation(source: Column, verb: str, target: Column) -> Column:
        return F.to_json(F.struct(F.lit("relationship").alias("type"), F.lit("2.1").alias("spec_version"), scalar.stix_id("relationship", _said(source, verb, target)).alias("id"), at.alias("created"), at.alias("modified"), F.lit(verb).alias("relationship_type"), source.alias("source_ref"), target.alias("target_ref")))

    objects = F.flatten(F.array(
        F.array(sdo("identity", who, F.lit("tidewatch"), identity_class=F.lit("system")), sdo("threat-actor", actor, _said("Unattributed [", _c("source_ip"), "]"), threat_actor_types=F.array(F.lit("unknown"))), sdo("attack-pattern", pattern, technique), indicator(_c("source_ip"), "ipv4-addr", 1.0)),
        _each("target_ips", 5, lambda t: indicator(t, "ipv4-addr", 0.8)),
        _each("domains", 10, lambda d: indicator(d, "domain-name", 0.9)),
        F.array(relation(actor, "uses", pattern), relation(scalar.stix_id("indicator", _c("source_ip")), "indicates", actor)),
    ))
    return _said('{"type":"bundle","id":"', scalar.stix_id("bundle", _c("incident_id")), '","objects":[', F.array_join(objects, ","), "]}")


RENDERERS = {"iptables": iptables, "nftables": nftables, "cisco_acl": cisco_acl, "dns_rpz": dns_rpz, "snort": snort, "stix": stix}


def artifacts(incidents: DataFrame) -> DataFrame:
    """Six drafts per incident: kind, content, syntax_valid (more than 20 characters), requires_human_approval (always true)."""
    drafts = F.array(*(F.struct(F.lit(kind).alias("kind"), render().alias("content")) for kind, render in RENDERERS.items()))
    out = incidents.select("incident_id", F.explode(drafts).alias("d")).select("incident_id", "d.kind", "d.content")
    return out.withColumns({"syntax_valid": F.coalesce(F.length(F.trim("content")) > 20, F.lit(False)), "requires_human_approval": F.lit(True)})


def artifact_input(triaged: DataFrame, iocs: DataFrame | None = None) -> DataFrame:
    """The columns that renderers need, of the triage's result and the indicators found in evidence."""
    df = triaged.withColumns({"subnet": scalar.subnet("source_ip"), "threat_class": F.col("intent"), "technique_id": F.get("technique_ids", 0)})
    if iocs is not None:
        return df.join(iocs, "incident_id", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    return df.withColumns({"domains": F.array().cast("array<string>"), "ja4": F.lit("")})
