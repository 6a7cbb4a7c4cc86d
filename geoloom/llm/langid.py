"""Language identification by compression.

Each language has a zstandard raw-content dictionary: normalised text from a
bounded sample of its labelled rows. A text is normalised alike, cut into blocks,
every block is encoded once with each dictionary, and the language that makes the
whole text smallest wins. The margin is how much smaller it is than the runner-up,
in bits a character; narrow margins are rejected.

What is narrow is learned: dictionaries of either half of the sampled rows are
tried on the other half, on windows of several lengths. A text that takes more bits a
character, or has a smaller lead, than almost all rightly told windows of its length
is like no learned language: it is rejected, with margin 0 and score 0.5.

Normalising (ASCII and other letters in lower case, all else to single spaces)
keeps case, punctuation and numbers from standing in for language.

A null text, or one with no letter, is ``und`` with score 0, rejected. With no
labelled row at all every text is ``und``; with one language it always wins, but may be rejected.
Ties go to the language that sorts first. Rows are answered on their own, so
repeated rows agree; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import bound_batches, stored

UNDETERMINED = "und"
#: Rows of each language that are sampled for its dictionary at most.
SAMPLE_ROWS = 512
#: Sampled rows up to which their hashes are broadcast to fetch the texts (24 bytes each).
BROADCAST_ROWS = 200_000
#: Bytes that a sampled row gives to the dictionary at most, and those of a dictionary.
ROW_BYTES, DICTIONARY_BYTES = 1024, 112 << 10
#: Characters of a block: small enough for the dictionary, and not the block's own past, to matter.
BLOCK_CHARS = 1000
LEVEL = 6
#: Narrower margins (bits a character) are rejected at any length.
MARGIN = 0.004
#: Characters of the windows that limits are learned from; shorter texts have none.
LENGTHS = (32, 48, 64, 96, 128, 192, 256, 384, 512, 768, BLOCK_CHARS)
#: Share of right windows beyond a limit, and what bits a character may exceed their limit by.
TAIL, SLACK = 0.01, 1.05
#: Windows that a limit takes at least; encodings of one length that are tried at most, about.
LEAST_WINDOWS, ENCODINGS = 20, 20_000
#: All but letters (Unicode categories L*): of what ``\\w`` takes, numerals and the underscore are none.
_NUMERALS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isnumeric() and unicodedata.category(c)[0] == "N"]
NOT_LETTERS = re.compile(r"[\W\d_" + "".join(c for c in _NUMERALS if c <= "\uffff") + "]+")
#: Numerals beyond the basic plane, which would slow the other pattern down, and what tells that a text may have some.
RARE_NUMERALS, RARE = re.compile("[" + "".join(c for c in _NUMERALS if c > "\uffff") + "]"), re.compile("[\U00010000-\U0010ffff]")


def normalise(text: str) -> str:
    text = text.lower()
    return NOT_LETTERS.sub(" ", RARE_NUMERALS.sub(" ", text) if RARE.search(text) else text)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id's text leaves remainder 1 by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def sample_by_language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Up to ``rows`` texts of each language, spread over the table by a hash of the id.

    The smallest hash of each of ``rows`` cells is found with map-side
    aggregation of (language, cell); only the texts of those rows are fetched.
    """
    h = F.xxhash64("doc_id", F.lit(11))
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    cells = labelled.groupBy("lang", F.pmod(h, F.lit(rows)).alias("cell")).agg(F.min(h).alias("h"))
    wanted = stored(cells.select("lang", "h"), "cells")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    picked = labelled.withColumn("h", h).join(wanted, ["lang", "h"], "left_semi")
    out: dict[str, list[str]] = {}
    seen = set()  # rows may repeat
    for r in picked.select("lang", "h", F.substring("text", 1, 4 * ROW_BYTES).alias("text")).orderBy("lang", "h").toLocalIterator():
        if (r.lang, r.h) not in seen:
            seen.add((r.lang, r.h))
            out.setdefault(r.lang, []).append(r.text)
    return out


def build_dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """Equal shares of the sampled texts, so that no language has more to match than another."""
    texts = {lang: [normalise(t).strip().encode()[:ROW_BYTES] for t in ts] for lang, ts in samples.items()}
    sizes = {lang: min(DICTIONARY_BYTES, sum(map(len, ts))) for lang, ts in texts.items()}
    return {lang: b" ".join(ts)[: sizes[lang]] for lang, ts in sorted(texts.items()) if sizes[lang]}


class Dictionaries(dict):
    """Dictionary of each language; limits: length -> (least lead in bits, {language: most bits a character})."""

    limits: dict[int, tuple[float, dict[str, float]]] = {}


def learn_limits(samples: dict[str, list[str]]) -> dict[int, tuple[float, dict[str, float]]]:
    """Limits by length, from windows of either half of the samples under the other half's dictionaries."""
    halves = [Classifier(build_dictionaries({lang: ts[k::2] for lang, ts in samples.items()})) for k in (0, 1)]
    rows = max(2 * LEAST_WINDOWS, ENCODINGS // max(1, len(samples)) ** 2)
    texts = [(lang, k, normalise(t).strip()) for lang, ts in sorted(samples.items()) for k, t in enumerate(ts[:rows])]
    limits = {}
    for length in LENGTHS:
        leads, rates = [], {}
        for lang, k, text in texts:
            other = halves[1 - k % 2]
            if len(text) < length or not other.encoders:
                continue
            start = (len(text) - length) // 2
            sizes, n = other.sizes(text[start : start + length])
            order = sorted(range(len(sizes)), key=lambda j: (sizes[j], j))
            if other.languages[order[0]] == lang:
                rates.setdefault(lang, []).append(8.0 * sizes[order[0]] / n)
                if len(order) > 1:
                    leads.append(8.0 * (sizes[order[1]] - sizes[order[0]]))
        most = {lang: SLACK * sorted(v)[int((1 - TAIL) * (len(v) - 1))] for lang, v in rates.items() if len(v) >= LEAST_WINDOWS}
        least = sorted(leads)[int(TAIL * len(leads))] if len(leads) >= LEAST_WINDOWS else 0.0
        if most or least:
            limits[length] = least, most
    return limits


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.languages = sorted(dictionaries)
        self.limits = sorted(getattr(dictionaries, "limits", {}).items(), reverse=True)
        self.encoders = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=d, **options).compress)

    def sizes(self, text: str) -> tuple[list[int], int]:
        """Bytes under each dictionary, and characters, of the whole normalised text."""
        blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
        return [sum([len(encode(b)) for b in blocks]) for encode in self.encoders], len(text)

    def unlike(self, lang: str, size: int, lead: float, n: int) -> bool:
        """Whether n characters in ``size`` bytes, ``lead`` bits ahead, are beyond the limits of the longest windows that are no longer."""
        known = [(length, least, most) for length, (least, most) in self.limits if length <= n]
        if not known:
            return False
        length, least, _ = known[0]
        blocks = n / length if length == BLOCK_CHARS else 1.0
        most = next((m[lang] for _, _, m in known if lang in m), float("inf"))
        return lead < least * blocks or 8.0 * size > most * n

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin in bits a character)."""
        plain = normalise(text or "").strip()
        if not plain or not self.encoders:
            return UNDETERMINED, 0.0, 0.0
        sizes, n = self.sizes(plain)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        spare = 8.0 * (sizes[order[1]] - sizes[order[0]]) if len(order) > 1 else float("inf")
        if self.unlike(self.languages[order[0]], sizes[order[0]], spare, n):
            return self.languages[order[0]], 0.5, 0.0
        if len(order) == 1:
            return self.languages[0], 1.0, 8.0
        margin = spare / n
        return self.languages[order[0]], 1.0 - 0.5 * 2.0 ** -min(spare / 8.0, 60.0), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row of docs."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value)
        for b in batches:
            found = [c.predict(t) for t in b.column("text").to_pylist()]
            langs, scores, margins = zip(*found) if found else ((), (), ())
            rejected = [lang == UNDETERMINED or m < margin for lang, m in zip(langs, margins)]
            arrays = [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "margin", "rejected"])

    schema = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def fit(docs: DataFrame) -> dict[str, bytes]:
    samples = sample_by_language(docs.select("doc_id", "text", "lang"))
    found = Dictionaries(build_dictionaries(samples))
    found.limits = learn_limits(samples)
    return found


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns and in one pass: nothing is joined."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value)
        for b in batches:
            found = [c.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array([lang != UNDETERMINED and m >= margin for lang, _, m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
