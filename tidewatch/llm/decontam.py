"""Benchmark decontamination in DataFrame functions only.

Every window of a benchmark item is cut into all its runs of k words; a document is read at every
s-th word only, where k + s - 1 is the window's length, so each occurrence of a window covers exactly
one run that is read. Hashes of those runs meet a broadcast hash set; the few places found are verified
on the words themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import fresh, hash_side, table, text_or_empty, written

WINDOW = 10
#: Runs of benchmark windows up to which their hash set is broadcast (some 50 bytes each); larger sets are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Bytes of the windows' words up to which the windows are broadcast for verification, however few they are.
MOST_BYTES = 64_000_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else; the quick built-in does that for texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _A, _Z))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), _BREAKS, -1), lambda w: w != "")


def run_and_step(length: int) -> tuple[int, int]:
    run = (length + 1) // 2
    return run, length - run + 1


def windows_of(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """item_id, length, words: all windows of each item; an item of fewer words is one window."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(text_or_empty(text)).alias("all")).where(F.size("all") > 0)
    length = F.least(F.size("all"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(1), F.size("all") - length + 1), lambda p: F.slice("all", p, length))
    return words.select("item_id", length.alias("length"), F.explode(cut).alias("words")).distinct()


def occurrences(docs: DataFrame, windows: DataFrame, key: str, words: str) -> DataFrame:
    """key, start (from 0), length and item_id of every occurrence of a window in the array `words`."""
    said = F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8))
    found = windows.groupBy("length").agg(F.count("*").alias("count"), said.alias("bytes")).collect()  # at most WINDOW rows
    runs_wanted = sum(r["count"] * run_and_step(r["length"])[1] for r in found)
    few = runs_wanted <= MOST_BROADCAST
    small = few and sum(r["bytes"] for r in found) <= MOST_BYTES
    send = lambda df, ok: F.broadcast(df) if ok else df
    lengths = sorted(r["length"] for r in found)
    if not lengths:
        lengths = [WINDOW]
    probes, parts = [], []
    for n in lengths:
        run, step = run_and_step(n)
        of_n = windows.where(F.col("length") == n)
        cuts = F.transform(F.sequence(F.lit(1), F.lit(n - run + 1)), lambda p: F.xxhash64(F.slice("words", p, run)))  # noqa: B023
        parts.append(of_n.select(F.lit(n).alias("length"), F.explode(cuts).alias("run")))
        last = F.size(words) - run + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        probes.append(F.transform(places, lambda p: F.struct(F.lit(n).alias("length"), p.alias("at"), F.xxhash64(F.slice(words, p, run)).alias("run"))))  # noqa: B023
    known = reduce(DataFrame.unionByName, parts).distinct()
    probe = F.concat(*probes) if len(probes) > 1 else probes[0]
    read = docs.select(key, words, F.explode(probe).alias("_p")).select(key, words, "_p.length", "_p.at", "_p.run")
    hit = read.join(send(known, few), ["length", "run"], "left_semi")
    # The window that covers the run starts up to (step - 1) words before it.
    step_of = reduce(lambda out, n: F.when(F.col("length") == n, run_and_step(n)[1]).otherwise(out), lengths, F.lit(1))
    first, last = F.greatest(F.lit(1), F.col("at") - step_of + 1), F.least(F.col("at"), F.size(words) - F.col("length") + 1)
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    tried = hit.select(key, "length", F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice(words, s, F.col("length")).alias("words")))).alias("_t"))
    tried = tried.select(key, "length", (F.col("_t.s") - 1).alias("start"), F.col("_t.words").alias("words"))
    return tried.join(send(windows, small), ["length", "words"]).select(key, "start", "length", "item_id")


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: the id, null or not, and a hash of id and text, so that only texts of one id could be taken for each other."""
    return F.struct(doc_id.alias("id"), F.xxhash64(doc_id, text).alias("hash"))


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """_key (as row_key makes it), hit (positions of hit words, ascending) and items, of the documents with hits."""
    keyed = docs.select(row_key(F.col(doc_id), F.col(text).cast("string")).alias("_key"), words_of(text_or_empty(text)).alias("_words"))
    # Repeated rows share a key, so their occurrences come more than once; sets take them once.
    found = occurrences(keyed, windows_of(items, item_id, item_text), "_key", "_words")
    found = found.groupBy("_key").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("item_id").alias("items"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    return found.select("_key", hit.alias("hit"), "items")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text, n_words, hit (positions of the hit words), items (ids of items with occurring windows) of every row of docs.

    Null and empty texts, and those without words, have no hits; so have all, if there are no
    items or none has words. Items are told apart by id; repeated items count once, repeated
    documents each. A null doc_id stays null; a null item_id is left out of `items`, while its
    windows still hit. Texts of any length are read whole; other columns play no part. Rows of one id
    whose texts have one 64-bit hash share their hits.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.withColumns({"_key": row_key(F.col("doc_id"), F.col("text")), "n_words": F.size(words_of(text_or_empty("text"))).cast("long")})
    found = hits(docs, items, doc_id, text, item_id, item_text)
    kind = items.schema[item_id].dataType.simpleString()
    return out.join(found, "_key", "left").select("doc_id", "text", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))


_WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  #: words before A-Z are lowered


def without_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_share: float = 0.5) -> DataFrame:
    """docs without benchmark passages: a document goes if more than most_share of its words are hit, else its hit words and what stands between them go.

    Untouched documents keep their text as it is, null included. All columns are kept, whatever they
    are called; repeated rows each stay or go alike; an empty table gives an empty one, and without
    items all stay; texts of any length are read whole. Rows of one id whose texts have one 64-bit
    hash are judged together.
    """
    key, clean, gone = fresh(docs, "_row", "_clean", "_gone")
    body = F.col(text).cast("string")
    keyed = docs.withColumn(key, row_key(F.col(doc_id), body))
    found = written(hits(docs, items, doc_id, text, item_id, item_text).select(F.col("_key").alias(key), F.col("hit").alias(gone)), "hits")
    # Only documents with hits are taken apart; the others meet a small table of what came of those.
    touched = keyed.select(key, body.alias(clean)).join(hash_side(found, F.size(gone) + 4, 5_000_000), key)
    n_words, rest = _taken_apart(F.col(clean), F.col(gone))
    touched = touched.select(key, rest.alias(clean), (F.size(gone) > most_share * n_words).alias(gone)).dropDuplicates([key])
    touched = written(touched, "touched")
    joined = keyed.join(hash_side(touched, F.octet_length(clean) + 16, 32_000_000), key, "left")
    kept = joined.where(F.col(gone).isNull() | ~F.col(gone))
    return kept.withColumn(text, F.when(F.col(gone).isNull(), body).otherwise(F.col(clean))).select(*docs.columns)


def _taken_apart(body: Column, hit: Column) -> tuple[Column, Column]:
    """(number of words of a text, the text without the words at the positions `hit`, ascending, and what stands between them)."""
    # gaps[i] stands before word i, the last gap after all.
    gaps, spelled = F.split(body, _WRITTEN, -1), F.regexp_extract_all(body, F.lit(_WRITTEN), F.lit(0))
    starts = F.filter(hit, lambda x, i: (i == 0) | (F.get(hit, i - 1) != x - 1))
    ends = F.filter(hit, lambda x, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != x + 1))
    # Before each run of hit words, and after the last one: the words since the run before, then the gap in front.
    both = F.array(F.struct(gaps.alias("gaps"), spelled.alias("words"), starts.alias("starts"), ends.alias("ends")))

    def rest(x: Column) -> Column:
        def part(k: Column) -> Column:
            first = F.when(k == 0, F.lit(0)).otherwise(F.get(x["ends"], k - 1) + 1)
            n = F.coalesce(F.get(x["starts"], k), F.size(x["words"])) - first
            said = F.zip_with(F.slice(x["gaps"], first + 1, n), F.slice(x["words"], first + 1, n), lambda g, w: F.concat(g, w))
            return F.concat(F.array_join(said, ""), F.get(x["gaps"], first + n))

        return F.struct(F.size(x["words"]).alias("n"), F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["starts"])), part), "").alias("rest"))

    made = F.element_at(F.transform(both, rest), 1)
    return made["n"], made["rest"]


def op10_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
b AS (
  SELECT item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id, n, array_to_string(words[p:p + n - 1], ' ') AS said
  FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(generate_series(1, len(words) - least(len(words), 10) + 1)) AS p FROM b WHERE len(words) > 0)),
each AS (
  SELECT row_id, n, p, array_to_string(words[p:p + n - 1], ' ') AS said
  FROM (SELECT row_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
hits AS (SELECT row_id, item_id, p, n FROM each JOIN w USING (n, said)),
covered AS (SELECT row_id, count(DISTINCT x) AS n_hit FROM (SELECT row_id, unnest(generate_series(p, p + n - 1)) AS x FROM hits) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)"""
