"""Line dedup by a log-template tree, in DataFrame functions only.

A line's words (parted by single spaces) with a digit are variable fields, ``<*>``. The
fixed-depth tree leads a line by its number of words and its first DEPTH words to a
leaf. A leaf holds the templates of its lines as they stand, and one generalised
template of the lines whose own template is not recurring: a place keeps the
word that at least half of them share (by documents; ties: the greatest word) and
is a variable field else. It counts if at least half of its places, and DEPTH + 1,
are kept, and takes the lines that agree with SIMILARITY of the kept places.

A template recurs if its lines stand in MIN_DOCS documents or more. All lines of
recurring templates are dropped but each one's first (smallest doc_id, then line
number), so what is repeated is kept once. Lines under MIN_WORDS words stay.

A null text stays null; an empty one is a line without words, which stays. A row
is known by the hash of its doc_id and text, so rows that repeat an id with
another text are documents of their own, and equal rows are one document and are
treated alike. Further columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import stored

DEPTH, MIN_WORDS, MIN_DOCS, SIMILARITY = 3, 3, 5, 0.8
KEY = "xxhash64(doc_id, text)"
#: Rows of templates (of up to 48 bytes) up to which they are broadcast to their lines; more are joined by shuffle.
BROADCAST_TEMPLATES = 1_000_000
WORDS = "if(line rlike '[0-9]', transform(split(trim(line), ' '), w -> if(w rlike '[0-9]', '<*>', w)), split(trim(line), ' '))"
NODE = f"named_struct('n', size(words), 'leaf', xxhash64(size(words), slice(words, 1, {DEPTH})), 'tmpl', xxhash64(words){{}})"


def tree_lines(docs: DataFrame, words: bool = False) -> DataFrame:
    """k, doc_id, line_no, n, leaf, tmpl (and masked words) of every line that the tree takes.

    The lines are parsed as an array of the document, before it is exploded, so
    that no filter on the outcome makes Spark parse them twice.
    """
    node = NODE.format(", 'words', words" if words else "")
    parsed = F.expr(rf"transform(transform(split(text, '\n'), line -> {WORDS}), words -> {node})")
    rows = docs.select("doc_id", F.expr(KEY).alias("k"), F.posexplode(parsed).alias("line_no", "node"))
    return rows.select("k", "doc_id", "line_no", "node.*").filter(F.col("n") >= MIN_WORDS)


def _small(templates: DataFrame) -> DataFrame:
    """A relation of templates, to be broadcast if it is small: their lines, of which there may be many, then stay where they are."""
    return F.broadcast(templates) if templates.count() <= BROADCAST_TEMPLATES else templates


def recurring_templates(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """leaf, tmpl, grp of all lines' templates that are recurring; grp: the template that stands for them."""
    pairs = lines.select("leaf", "tmpl", "k").distinct()
    templates = stored(pairs.groupBy("leaf", "tmpl").agg(F.count(F.lit(1)).alias("docs")), "templates")
    exact = templates.filter(F.col("docs") >= min_docs).select("leaf", "tmpl", F.col("tmpl").alias("grp"))
    rest = templates.filter(F.col("docs") < min_docs)
    # leaves where lines of several rare templates stand in enough documents together
    leaves = rest.groupBy("leaf").agg(F.sum("docs").alias("weight"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("weight") >= min_docs))
    rest = stored(rest.join(leaves.select("leaf", "weight"), "leaf"), "rare")
    rest = _small(rest)
    # one line of each such template, read again: only few lines' words are ever moved
    words = tree_lines(docs, words=True).join(rest, ["leaf", "tmpl"]).groupBy("leaf", "tmpl", "docs", "weight").agg(F.min("words").alias("words"))
    words = stored(words, "words")
    votes = words.select("leaf", "docs", "weight", F.posexplode("words").alias("place", "word"))
    votes = votes.groupBy("leaf", "place", "weight", "word").agg(F.sum("docs").alias("votes"))
    kept = votes.groupBy("leaf", "place", "weight").agg(F.max(F.struct("votes", "word")).alias("top"))
    kept = kept.filter(F.col("top.votes") * 2 >= F.col("weight"))
    kept = kept.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", F.col("top.word").alias("word")))).alias("kept"))
    agree = "size(filter(kept, c -> element_at(words, c.place + 1) = c.word))"
    close = words.join(kept, "leaf").filter(f"size(kept) * 2 >= size(words) and size(kept) > {DEPTH} and {agree} >= {SIMILARITY} * size(kept)").select("leaf", "tmpl")
    close = stored(close, "close")
    enough = pairs.join(close, ["leaf", "tmpl"]).select("leaf", "k").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    general = close.join(enough.select("leaf"), "leaf").select("leaf", "tmpl", F.xxhash64("leaf", F.lit("general")).alias("grp"))
    return exact.unionByName(general)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """k, drop (line numbers) of every document that loses lines."""
    lines = stored(tree_lines(docs).select("k", "doc_id", "line_no", "leaf", "tmpl"), "lines")
    recurring = _small(stored(recurring_templates(docs, lines, min_docs), "recurring"))
    hits = stored(lines.join(recurring, ["leaf", "tmpl"]).select("grp", "doc_id", "k", "line_no"), "hits")
    at = F.struct("doc_id", "k", "line_no")
    first = _small(stored(hits.groupBy("grp").agg(F.min(at).alias("first")), "first"))
    lost = hits.join(first, "grp").filter(at != F.col("first"))
    return lost.groupBy("k").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def count_names(columns: list[str]) -> tuple[str, str]:
    """Names of the two counts: __n_lines and __n_dropped, with underscores added where docs has such a column."""
    out = []
    for name in ("__n_lines", "__n_dropped"):
        while name in columns:
            name += "_"
        out.append(name)
    return out[0], out[1]


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the kept lines as ``text``, and two counts (see ``count_names``)."""
    names = docs.columns
    n_lines, n_dropped = count_names(names)
    row = docs.select(F.struct(*names).alias("row"), F.expr(KEY).alias("k"), F.col("text").alias("text"))
    out = row.join(dropped_lines(docs, min_docs), "k", "left")
    parts = F.split("text", "\n")
    keep = F.expr(r"array_join(filter(split(text, '\n'), (x, i) -> not array_contains(drop, i)), '\n')")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(keep)
    columns = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names]
    return out.select(*columns, F.coalesce(F.size(parts), F.lit(0)).alias(n_lines), F.coalesce(F.size("drop"), F.lit(0)).alias(n_dropped))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"), "text")


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {
    "op6_line_dedup": f"""
with rows as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents
), lines as (
  select doc_id, i - 1 as line_no,
         list_transform(string_split(trim(lines[i], ' '), ' '), lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end) as words
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from rows)
), tree as (
  select *, concat(len(words), ' ', list_aggregate(words[1:{DEPTH}], 'string_agg', ' ')) as leaf, list_aggregate(words, 'string_agg', ' ') as tmpl
  from lines where len(words) >= {MIN_WORDS}
), templates as (
  select leaf, tmpl, any_value(words) as words, count(distinct doc_id) as docs from tree group by leaf, tmpl
), rest as (
  select *, sum(docs) over (partition by leaf) as weight, count(*) over (partition by leaf) as n from templates where docs < {MIN_DOCS}
), cand as (
  select * from rest where n > 1 and weight >= {MIN_DOCS}
), votes as (
  select leaf, place, weight, words[place] as word, sum(docs) as votes
  from (select leaf, words, docs, weight, unnest(range(1, len(words) + 1)) as place from cand) group by leaf, place, weight, words[place]
), kept as (
  select leaf, place, word from (select *, row_number() over (partition by leaf, place order by votes desc, word desc) as r from votes)
  where r = 1 and votes * 2 >= weight
), score as (
  select c.leaf, c.tmpl, len(any_value(c.words)) as n, count(*) as kept, count(*) filter (where c.words[k.place] = k.word) as same
  from cand c join kept k on c.leaf = k.leaf group by c.leaf, c.tmpl
), near as (
  select leaf, tmpl from score where kept * 2 >= n and kept > {DEPTH} and same >= {SIMILARITY} * kept
), enough as (
  select t.leaf from tree t join near c on t.leaf = c.leaf and t.tmpl = c.tmpl group by t.leaf having count(distinct t.doc_id) >= {MIN_DOCS}
), recurring as (
  select leaf, tmpl, concat('exact ', tmpl) as grp from templates where docs >= {MIN_DOCS}
  union all
  select leaf, tmpl, concat('general ', leaf) as grp from near where leaf in (select leaf from enough)
), hits as (
  select t.doc_id, t.line_no, row_number() over (partition by grp order by t.doc_id, t.line_no) as r
  from tree t join recurring c on t.leaf = c.leaf and t.tmpl = c.tmpl
), lost as (
  select doc_id, list(line_no) as gone from hits where r > 1 group by doc_id
)
select r.doc_id, coalesce(len(r.lines), 0)::bigint as n_lines, coalesce(len(l.gone), 0)::bigint as n_dropped,
       case when l.gone is null then r.text
            else coalesce(list_aggregate([r.lines[i] for i in range(1, len(r.lines) + 1) if not list_contains(l.gone, i - 1)], 'string_agg', chr(10)), '') end as text
from rows r left join lost l on r.doc_id = l.doc_id
"""
}
