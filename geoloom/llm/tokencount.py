"""Token counts by a map-side two-tier lookup.

Texts are cut into pre-tokens by the tokenizer's own pattern. Tier one is a
broadcast hash table from frequent pre-tokens to their numbers of tokens: the
vocabulary's whole pre-tokens (byte-pair merges are learned by frequency), so its
size is bounded by the vocabulary and no pass over the corpus is needed. Tier two
is a bounded cache in each Python worker, filled by encoding the misses of a
batch. No pre-token is ever shuffled.

A null or empty text has 0 tokens. Special strings inside texts count as one
token, as is the library's default. Every row is answered on its own: repeated
rows and ids give repeated results, and other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 512
#: Entries of a worker's cache; when it is full, the oldest half goes.
CACHE_ENTRIES = 600_000
#: Characters of text that are cut before their misses are encoded together.
GROUP_CHARS = 1 << 20
#: Longer pre-tokens are encoded each time and never kept.
CACHE_CHARS = 64
# How byte-level byte-pair tokenizers of this family cut text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_tokenizer(definition: str):
    """The library's tokenizer; refuses a definition that cuts texts in another way than PATTERN, or changes them first."""
    import json

    spec = json.loads(definition)
    cut = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("only byte-level tokenizers with the usual pattern, without normalizer or added space, are covered")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens") or []):
        raise ValueError("only plain special strings are covered")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


class Counter:
    """Counts tokens of texts; one for each worker."""

    def __init__(self, definition: str, frequent: dict[str, int], entries: int = CACHE_ENTRIES):
        import regex

        self.tokenizer = load_tokenizer(definition)
        self.frequent, self.cache, self.entries = frequent, {}, entries
        self.cut = regex.compile(PATTERN).findall
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, texts: list[str | None]) -> list[int]:
        """Numbers of tokens; texts are taken in groups of about GROUP_CHARS."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                out += self._count(group)
                group, size = [], 0
        return out + self._count(group)

    def _count(self, texts: list[str]) -> list[int]:
        if len(self.cache) > self.entries:
            for x in list(islice(self.cache, self.entries // 2)):  # the oldest
                del self.cache[x]
        out = []
        cuts = []
        for t in texts:
            pieces = self.special.split(t) if self.special and self.special.search(t) else [t]
            out.append(len(pieces) - 1)
            cuts.append([x for p in pieces for x in self.cut(p)] if len(pieces) > 1 else self.cut(t))
        frequent, cache = self.frequent, self.cache
        missing = list({x for tokens in cuts for x in tokens if x not in frequent and x not in cache})
        new = dict(zip(missing, (len(e) for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False))))
        cache.update((x, k) for x, k in new.items() if len(x) <= CACHE_CHARS)
        return [n + sum([frequent.get(x) or cache.get(x) or new[x] for x in tokens]) for n, tokens in zip(out, cuts)]


def frequent_lengths(definition: str) -> dict[str, int]:
    """Tier one: numbers of tokens of the vocabulary's entries that are one pre-token."""
    import regex

    t, cut = load_tokenizer(definition), regex.compile(PATTERN)
    words = [w for w in (t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size(with_added_tokens=False))) if "�" not in w and cut.fullmatch(w)]
    return dict(zip(words, (len(e.ids) for e in t.encode_batch(words, add_special_tokens=False))))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition, frequent_lengths(definition)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            n = counter.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
