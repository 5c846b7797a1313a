"""Incremental blob ledger for secret scans, in DataFrame functions only.

A version's content is addressed by its SHA-256. Only (blob, rule version) pairs that the ledger
doesn't hold are scanned, one representative row per blob, and findings are joined back to every
path that ever held the blob. Only digests meet in the grouping, so a blob with a third of all
paths adds up in the map-side combine; the join back leaves the split of hot blobs to AQE. Texts
are scanned where they are read: what is sent to them is a checked number of digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import MOST_SENT, files_for, hash_side, table, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  #: for Java's and RE2's engines alike
    group: int = 0  #: the group whose length counts
    least: int = 0  #: characters that it needs
    base: bool = False
    needs: str = ""  #: a cheap necessary pattern, for rare kinds


# Kinds, patterns and least lengths of the base rules, and public formats of issued keys.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh[pousr]_"),
    Rule("slack", r"xox[abposr]-[A-Za-z0-9-]{10,}", needs="xox[abposr]-"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", needs="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needs="eyJ"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}", needs="sk_live_"),
)
VERSION = "2026-1"
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
_AT_ONCE = 128  #: hits that are added up in one go; each go copies what it has so far


def _once(value: Column, of) -> Column:
    """of(value), where value is computed once however often `of` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: what lies between the matches gives the places."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        if rule.least:
            span = F.when(x["good"], span).otherwise(none)
        return F.struct(end.alias("at"), F.concat(acc["out"], span).alias("out"))

    def added(pairs: Column, start: Column) -> Column:
        return F.aggregate(pairs, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def measured(gap: Column, hit: Column) -> Column:
        good = F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), good.alias("good"))

    def in_parts(pairs: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _AT_ONCE).cast("int"))
        own = lambda k: F.slice(pairs, k * _AT_ONCE + 1, _AT_ONCE)
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
        lengths = F.transform(parts, lambda k: total(F.transform(own(k), lambda x: x["gap"] + x["hit"])))
        return _once(lengths, lambda sums: F.flatten(F.transform(parts, lambda k: added(own(k), F.when(k == 0, F.lit(0)).otherwise(total(F.slice(sums, 1, k)))))))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, measured)
    found = _once(pairs, lambda p: F.when(F.size(p) <= _AT_ONCE, added(p, F.lit(0))).otherwise(in_parts(p)))
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(none)


def scanned(blobs: DataFrame, content: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs with a column `spans`: every rule's spans by start, then by the rule's place in the list."""
    text = F.col(content)
    common = [_spans(text, r, n) for n, r in enumerate(rules) if not r.needs]
    rare = [(r, _spans(text, r, n)) for n, r in enumerate(rules) if r.needs]
    out = F.concat(*common)
    if rare:
        some = "(?:" + "|".join(r.needs for r, _ in rare) + ")"
        out = F.concat(out, F.when(F.rlike(text, F.lit(some)), F.concat(*(s for _, s in rare))).otherwise(F.array().cast(_SPAN)))
    return blobs.withColumn("spans", F.array_sort(out))


def addressed(versions: DataFrame, path: str, content: str) -> DataFrame:
    """path, content and blob, the content's SHA-256; null content is empty."""
    return versions.select(F.col(path).alias("path"), text_or_empty(content).alias("content")).withColumn("blob", F.unhex(F.sha2("content", 256)))


def scan_unseen(versions: DataFrame, path: str = "path", content: str = "content", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION, most: int = MOST_SENT) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) of the blobs that the ledger lacks under this rule version.

    Every scanned blob gets a row, also without spans, so that it isn't scanned again. A blob that
    several rows hold is scanned once: at the path with the least hash. Null and empty contents are
    one blob; a null path is a path; repeated rows count once; an empty table gives no rows, and so
    does one whose blobs the ledger holds; contents of any length are read whole; other columns play
    no part.
    """
    all_rows = addressed(versions, path, content).withColumn("key", F.xxhash64("path"))
    blobs = all_rows.groupBy("blob").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    if ledger is None:
        blobs = blobs.withColumn("known", F.lit(False))
    else:
        held = ledger.where(F.col("rule_version") == version).select("blob").distinct().withColumn("known", F.lit(True))
        blobs = blobs.join(held, "blob", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    blobs = written(blobs, "blobs", files_for(versions.count()))
    new, other = blobs.where("not known").select("blob", F.col("least").alias("key")), blobs.where("known or n > 1").select("blob", "least", "known")
    n_new, n_other = new.count(), other.count()
    if n_new <= min(most, n_other):
        # Little is new: its digests choose the rows.
        todo = all_rows.join(hash_side(new, n=n_new, most=most), ["blob", "key"], "left_semi")
    else:
        # Most is new: digests of what is known or there more than once leave rows out. Beyond `most` of them, texts are dealt by blob.
        todo = all_rows.join(hash_side(other, n=n_other, most=most), "blob", "left").where(F.col("known").isNull() | (~F.col("known") & (F.col("key") == F.col("least"))))
    # A repeated row has its blob's key twice; the ledger takes a blob once.
    spans = scanned(todo.select("blob", "content"), "content", rules).groupBy("blob").agg(F.first("spans").alias("spans"))
    return spans.select("blob", F.lit(version).alias("rule_version"), "spans")


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: str = "path", content: str = "content", version: str = VERSION) -> DataFrame:
    """Every row's path and blob with the ledger's spans of that blob (an empty array where there are none, or no row in the ledger).

    Null and empty contents are one blob; a null path stays null; repeated rows each get their row;
    an empty table gives an empty one; contents of any length are read whole; other columns play no part.
    """
    known = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    rows = addressed(versions, path, content).select("path", "blob")
    return rows.join(known, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir):
    """doc_id as the path, text as its one version, an empty ledger before.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows each get their row;
    an empty table gives none; other columns play no part.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The ledger is a table: so no filter on findings moves the scan before the choice of what to scan.
    ledger = written(scan_unseen(docs, "doc_id", "text"), "ledger", files_for(docs.count()))
    found = findings_by_path(docs, ledger, "doc_id", "text")
    spans, n_base = F.col("spans"), sum(r.base for r in RULES)
    base = F.filter(spans, lambda s: s["rank"] < n_base)
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(number(r.kind).alias(f"n_{r.kind}") for r in RULES if r.base),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def _sql() -> str:
    one = "SELECT doc_id, row_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps{more} FROM d"
    parts = []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        more = f", list_transform(regexp_extract_all(text, '{p}', {r.group}), lambda x: length(x) >= {r.least}) AS good" if r.least else ", NULL AS good"
        parts.append(one.format(rank=n, kind=r.kind, p=p, more=more))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (
  SELECT row_id, rank, kind, hits, gaps, good, unnest(generate_series(1, len(hits))) AS i FROM found WHERE len(hits) > 0),
placed AS (
  SELECT row_id, rank, kind, hits[i] AS hit, coalesce(good[i], true) AS good,
    CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM each),
spans AS (SELECT row_id, rank, kind, s, kind || ':' || s || ':' || (s + length(hit)) AS said FROM placed WHERE good),
summed AS (
  SELECT row_id, {counts},
    string_agg(said, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS base, string_agg(said, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY row_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (row_id)"""


SQL = _sql()
