"""Benchmark decontamination by spaced-seed hashing.

Words (lower case, ASCII punctuation parts them) are hashed; a fixed mask picks
some of SPAN successive words, and the picked words' hash is a seed. Seeds of the
whole documents are joined with those of the benchmark by look-up: a bit table
first, then the sorted seeds. Around every hit, the item is laid over the document
at the hit's diagonal. The overlap is verified if IDENTITY (0.8) of the item's words
agree, or else if the best segment (+1 a match, -4 a substitution, so 0.8 of its
words agree) has LEAST_MATCHES matching words.

The benchmark is indexed in blocks of BLOCK_BYTES at most, each of which is
broadcast in turn; so no size of it is out of bounds. Equal items are indexed
once and reported for each id. Items shorter than SPAN words are sought whole
and without substitutions. An item without words is not sought.

A null or empty text has no hit. Each row of docs reports each item at most once,
by its best segment (ties: the first). Repeated rows repeat their report. Other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.wordhash import NOT_ALNUM, hash_words, mix, word_groups
from geoloom.session import bound_batches

# The masks; 0 marks a word that is ignored.
MASKS = ("11011011", "11101011", "10111101", "11110011")
SPAN = 8
LEAST_MATCHES, IDENTITY, LEAST_WORDS = 12, 0.8, 1
#: Bytes of benchmark text in a broadcast block, and bits of the table of seeds.
BLOCK_BYTES, TABLE_BITS = 8 << 20, 22
#: Hits that are held at once, hits of one seed in a document beyond which its places are shifted as bits, and words that are laid over at once.
HITS, MANY_HITS, OVERLAID = 1 << 21, 1 << 14, 1 << 20
_FACTORS = mix(np.arange(1, SPAN + 1, dtype=np.uint64)) | np.uint64(1)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, len(mask) * 1315423911 + int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += words[k : k + n] * _FACTORS[k]
    return total ^ (total >> np.uint64(32))


class Index:
    """Seeds of a block of items, and the items' words."""

    def __init__(self, items: list[tuple[int, str | None]]):
        known: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.words: list[np.ndarray] = []
        for item_id, text in items:
            w, _ = hash_words((text or "").lower().encode(), NOT_ALNUM)
            if len(w) < LEAST_WORDS:
                continue
            k = known.setdefault(w.tobytes(), len(known))
            if k == len(self.ids):
                self.ids.append([])
                self.words.append(w)
            self.ids[k].append(item_id)
        self.masks = [*MASKS, *sorted({"1" * len(w) for w in self.words if len(w) < SPAN})]
        self.tables = []
        for mask in self.masks:
            long = "0" in mask
            found = [(s, k, p) for k, w in enumerate(self.words) if (len(w) >= SPAN if long else len(w) == len(mask)) for p, s in enumerate(seeds(w, mask).tolist())]
            found.sort()
            hashes = np.array([f[0] for f in found], np.uint64)
            bits = np.zeros(1 << TABLE_BITS, bool)
            bits[hashes & np.uint64((1 << TABLE_BITS) - 1)] = True
            self.tables.append((bits, hashes, np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)))

    def diagonals(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(document, item, place of the item's first word in the document) of all hits of seeds: sorted rows, once each.

        Hits are taken in parts of HITS at most. A seed that repeats so often in
        texts and items that its hits would be many more than its places is
        not taken hit by hit: places are bits, and each of an item's places
        shifts the document's.
        """
        low = np.uint64((1 << TABLE_BITS) - 1)
        far = max(map(len, self.words))
        span = len(words) + far + 1
        rows: list[np.ndarray] = [np.empty(0, np.int64)]  # a number for each (document, item, place)
        for mask, (bits, hashes, items, places) in zip(self.masks, self.tables):
            s = seeds(words, mask)
            at = np.flatnonzero(bits[s & low])
            first, last = np.searchsorted(hashes, s[at]), np.searchsorted(hashes, s[at], side="right")
            n = last - first
            at, first, n = at[n > 0], first[n > 0], n[n > 0]
            doc = np.searchsorted(bounds, at + len(mask) - 1, side="right") - 1
            key = first * len(bounds) + doc
            _, which, times = np.unique(key, return_inverse=True, return_counts=True)
            many = (times[which] * n > MANY_HITS) & (n > 1) & (times[which] > 1)
            heavy = np.flatnonzero(many)
            heavy = heavy[np.argsort(key[heavy], kind="stable")]
            for mine in np.split(heavy, np.flatnonzero(np.diff(key[heavy])) + 1) if len(heavy) else []:
                d, lo, hi = int(doc[mine[0]]), int(first[mine[0]]), int(first[mine[0]] + n[mine[0]])
                for item, begins in self._shifted(at[mine] - bounds[d], items[lo:hi], places[lo:hi]):
                    rows.append((d * len(self.words) + item) * span + begins + far)
            at, first, n, doc = at[~many], first[~many], n[~many], doc[~many]
            ends = np.cumsum(n)
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS, side="right")))
                part = n[start:stop]
                k = np.repeat(first[start:stop] - (np.cumsum(part) - part), part) + np.arange(part.sum())
                d = np.repeat(doc[start:stop], part)
                rows.append(np.unique((d * len(self.words) + items[k]) * span + np.repeat(at[start:stop], part) - places[k] - bounds[d] + far))
                start = stop
        pair, begin = np.divmod(np.unique(np.concatenate(rows)), span)
        return np.stack([pair // len(self.words), pair % len(self.words), begin - far], axis=1)

    @staticmethod
    def _shifted(at: np.ndarray, items: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places of its first word) of one seed's places in a document with each item's places of it."""
        marks = np.zeros(int(at.max()) + 1, np.uint8)
        marks[at] = 1
        mine = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
        for item in np.unique(items).tolist():
            there = places[items == item]
            far, met = int(there.max()), 0
            for place in there.tolist():
                met |= mine << far - place
            bits = np.frombuffer(met.to_bytes((met.bit_length() + 7) // 8, "little"), np.uint8)
            yield item, np.flatnonzero(np.unpackbits(bits, bitorder="little")) - far

    def best(self, words: np.ndarray, item: int, begins: np.ndarray) -> tuple[int, int, int, int] | None:
        """The best verified segment over all diagonals of a document and an item: by score, then the first.

        Diagonals are laid over together, in order. A whole match ends the search; a
        diagonal whose words that agree are fewer than the best score can't beat it.
        """
        w, found, score = self.words[item], None, None
        step = max(1, OVERLAID // len(w))
        padded = np.concatenate([np.zeros(len(w), np.uint64), words, np.zeros(len(w), np.uint64)])
        views = np.lib.stride_tricks.sliding_window_view(padded, len(w))
        for k in range(0, len(begins), step):
            part = begins[k : k + step]
            part = part[(part > -len(w)) & (part < len(words))]
            same = views[part + len(w)] == w
            n = np.minimum(len(words) - part, len(w)) + np.minimum(part, 0)  # words of the item that lie on the document
            for row in np.flatnonzero(n < len(w)).tolist():
                lo = max(0, -int(part[row]))
                same[row, :lo] = same[row, lo + int(n[row]) :] = False
            whole = same.sum(axis=1)
            close = whole >= IDENTITY * len(w)
            tried = np.flatnonzero(~close & (whole >= LEAST_MATCHES)).tolist()
            if close.any():
                gain, begin = (5 * whole - 4 * n)[close], np.maximum(part, 0)[close]
                tried.append(int(np.flatnonzero(close)[np.lexsort((begin, -gain))[0]]))
            for row in tried:
                if score is not None and whole[row] < score:
                    continue
                new = self.verify(words, int(part[row]), item)
                if new and (score is None or (new[0] - 4 * new[1], -new[2]) > (score, -found[2])):
                    found, score = new, new[0] - 4 * new[1]
            if score == len(w):
                break
        return found

    def verify(self, words: np.ndarray, begin: int, item: int) -> tuple[int, int, int, int] | None:
        """(matches, substitutions, first word in the document, first word in the item) of the best segment."""
        w = self.words[item]
        lo, hi = max(0, -begin), min(len(w), len(words) - begin)
        same = words[begin + lo : begin + hi] == w[lo:hi]
        whole = int(same.sum())
        if whole >= IDENTITY * len(w):
            return whole, hi - lo - whole, begin + lo, lo
        run = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
        gain = run - np.minimum.accumulate(run)
        end = len(gain) - 1 - int(gain[::-1].argmax())
        start = int(run[: end + 1].argmin())
        matches = int(same[start:end].sum())
        return (matches, end - start - matches, begin + lo + start, lo + start) if matches >= LEAST_MATCHES else None

    def overlaps(self, texts: list[str | None]) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        """(number of the text, item id, segment) of all verified overlaps."""
        if not self.words:
            return
        for first, words, bounds in word_groups([(t or "").lower().encode() for t in texts], NOT_ALNUM):
            rows = self.diagonals(words, bounds)
            cuts = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1 if len(rows) else []
            best = {}
            for part in np.split(rows, cuts) if len(rows) else []:
                d, k = int(part[0, 0]), int(part[0, 1])
                found = self.best(words[bounds[d] : bounds[d + 1]], k, part[:, 2])
                if found:
                    best[d, k] = found
            for (d, k), found in sorted(best.items()):
                for item_id in self.ids[k]:
                    yield first + d, item_id, found


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's rows in blocks of about ``block_bytes``."""
    total = benchmark.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    slim = benchmark.select(F.col("item_id").cast("long"), "text")
    for k in range(n):
        part = slim if n == 1 else slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


SCHEMA = "doc_id long, item_id long, matches int, substitutions int, doc_word int, item_word int"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each contaminated row of docs and item that overlaps it."""
    bound_batches(docs.sparkSession)
    spark, slim, out = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text"), None
    for items in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in batches:
                ids, rows = b.column("doc_id"), list(index.overlaps(b.column("text").to_pylist()))
                numbers = pa.array([r[0] for r in rows], pa.int64())
                columns = [ids.take(numbers), pa.array([r[1] for r in rows], pa.int64())]
                columns += [pa.array([r[2][k] for r in rows], pa.int32()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        part = slim.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that overlap no item, with all their columns; nothing is joined."""
    spark = docs.sparkSession
    bound_batches(spark)
    for items in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in batches:
                hit = {r[0] for r in index.overlaps(b.column(b.schema.get_field_index("text")).to_pylist())}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
SQL: dict[str, str] = {}
