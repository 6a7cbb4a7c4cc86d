"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger
holds a row for each (blob, rule version) that has been scanned; only pairs that
it lacks are scanned, each once however many paths hold the blob, and findings
are joined back to all paths.

Rules (``assign``, ``access``, ``hex``) give leftmost non-overlapping matches;
offsets are code points, end exclusive. A null text counts as empty. Repeated
rows and repeated paths keep a row each. An empty table gives an empty result;
an empty ledger, or None, means that nothing was scanned. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import stored

RULE_VERSION = "2024.1"
# Kind, pattern, group whose length counts, least length.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(kind: int, text: str) -> str:
    """SQL for the spans of one rule, in order of start, in n ** (4 / 3) steps of copying for n matches.

    The text is cut at its matches; a match starts where the lengths before it
    end. They are summed for runs of about n ** (1 / 3) matches first, then in
    each run, so that no array that grows by a match at a time is long.
    """
    _, pattern, group, least = RULES[kind]
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    length = f"length(regexp_extract(x, '{quoted}', {group}))" if group else "length(x)"
    parts = f"zip_with(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0), (p, x) -> named_struct('gap', length(p), 'len', coalesce(length(x), 0), 'ok', {length} >= {least}))"
    none = f"cast(array() as {SPAN})"
    width = "cast(ceil(cbrt(size(z))) as int)"
    runs = f"transform(sequence(1, size(z), {width}), k -> slice(z, k, {width}))"
    starts = "aggregate(rs, array(0), (a, run) -> concat(a, array(element_at(a, -1) + aggregate(run, 0, (t, e) -> t + e.gap + e.len))))"
    span = f"array(named_struct('start', b.at + e.gap, 'kind', {kind}, 'end', b.at + e.gap + e.len))"
    found = f"aggregate(run, named_struct('at', at, 'found', {none}), (b, e) -> named_struct('at', b.at + e.gap + e.len, 'found', if(e.ok, concat(b.found, {span}), b.found)), b -> b.found)"
    every = f"transform(array({runs}), rs -> flatten(zip_with(rs, slice({starts}, 1, size(rs)), (run, at) -> {found})))[0]"
    return f"transform(array({parts}), z -> if(size(z) < 2, {none}, {every}))[0]"


def find_spans(text: str) -> str:
    """SQL for all spans of a text column, by start, then kind."""
    return f"array_sort(concat({', '.join(_spans(k, text) for k in range(len(RULES)))}))"


def blob_address(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of ``docs`` that the ledger lacks: blob, rule_version, spans.

    One row of each unseen blob is elected by its smallest doc_id; the join that
    fetches its text has a key for each row, so a text that many paths share is
    no hot key, and the small side is the one that is hashed.
    """
    elected = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        elected = elected.join(seen, "blob", "left_anti")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), blob_address().alias("blob"))
    elected = elected.select(F.col("doc_id").alias("__id"), F.col("blob").alias("__blob"))
    once = texts.join(elected.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("blob") == F.col("__blob")), "left_semi")
    return once.select("blob", F.lit(rule_version).alias("rule_version"), F.expr(find_spans("text")).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of docs: doc_id, blob, spans), (ledger with the new blobs). What is new is scanned once and stored for both."""
    paths = stored(docs.select("doc_id", blob_address().alias("blob")), "paths")
    new = stored(scan_unseen(docs, paths, ledger, rule_version), "ledger")
    known = new if ledger is None else new.unionByName(ledger.filter(F.col("rule_version") == rule_version))
    hits = known.filter(F.size("spans") > 0).dropDuplicates(["blob"]).select("blob", "spans")
    found = paths.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")))
    ledger_now = new.dropDuplicates(["blob"]) if ledger is None else ledger.unionByName(new.dropDuplicates(["blob"]))
    return found.select("doc_id", "blob", "spans"), ledger_now


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; the digest columns are made from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = scan(docs)
    names = ", ".join(f"'{r[0]}'" for r in RULES)
    joined = f"array_join(transform(spans, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)").alias(f"n_{r[0]}") for k, r in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined), 256).alias("base_sha256"), F.expr(joined).alias("spans"))


QUERIES = {"op10_secret_scans": op10_secret_scans}


def _sql_spans(kind: int) -> str:
    _, pattern, group, least = RULES[kind]
    quoted = pattern.replace("'", "''")
    length = f"length(regexp_extract(e.x, '{quoted}', {group}))" if group else "length(e.x)"
    none = "cast([] as struct(s bigint, k integer, e bigint)[])"
    at = "(a.p + instr(substr(text, a.p + 1), e.x) - 1)"
    return f"""list_reduce(list_transform(regexp_extract_all(text, '{quoted}'), lambda x: {{'p': 0::bigint, 'x': x, 'found': {none}}}),
      lambda a, e: {{'p': {at} + length(e.x), 'x': e.x, 'found': case when {length} >= {least} then list_append(a.found, {{'s': {at}, 'k': {kind}, 'e': {at} + length(e.x)}}) else a.found end}},
      {{'p': 0::bigint, 'x': '', 'found': {none}}}).found"""


_NAMES = ", ".join(f"'{r[0]}'" for r in RULES)
SQL = {
    "op10_secret_scans": f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
f as (select doc_id, list_sort(list_concat({', '.join(_sql_spans(k) for k in range(len(RULES)))})) as spans from t),
j as (select doc_id, spans as found, coalesce(array_to_string(list_transform(spans, lambda s: [{_NAMES}][s.k + 1] || ':' || s.s || ':' || s.e), ','), '') as spans from f)
select doc_id, {', '.join(f"len(list_filter(found, lambda s: s.k = {k}))::bigint as n_{r[0]}" for k, r in enumerate(RULES))}, sha256(spans) as base_sha256, spans from j
"""
}
