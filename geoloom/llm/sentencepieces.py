"""SentencePiece encoding and decoding with a streaming Viterbi lattice.

The model is a byte-pair one with byte fallback. Its segmentation of a prefix is
unique, and a piece may follow another exactly if the two together are segmented
into just these two. So the lattice keeps, for every boundary, the one piece that
may end there (back-pointer), and looks back no further than the longest piece.
Ids are committed as soon as the paths of all boundaries that a later piece may
still start from have met in one boundary; what lies before is then forgotten.

Two boundaries are known beforehand, because no piece holds their insides: before
a space mark that follows another character, and around characters that no piece
holds. What lies between them is a unit; a bounded cache keeps units' ids.

Scores tie among the pieces of space marks alone, whose segmentation then depends
on order; runs of two and more marks are merged directly, in the model's order.

``encode`` gives the library's ids; ``decode`` gives back the text. A null text is
encoded like the empty one, to no ids. U+2581 in a text decodes to a space, as
in the library: such texts are not ``lossless``. Rows are answered on their own;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import bound_batches

SPACE = "▁"
#: Entries of a worker's cache of units, and of its cache of pairs of pieces; when one is full, half of it goes.
CACHE_ENTRIES, PAIR_ENTRIES = 400_000, 500_000
#: Longer units are never kept.
CACHE_CHARS = 48
#: Characters after which a long unit's lattice looks for a common boundary.
WINDOW = 64
#: Characters of texts that are answered together in one Arrow batch.
GROUP_CHARS = 2 << 20
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
OUTSIDE = -1  # a character that no piece holds


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes, entries: int = CACHE_ENTRIES):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.escape_whitespaces and spec.add_dummy_prefix and proto.trainer_spec.byte_fallback):
            raise ValueError("only byte-pair models with byte fallback and no normalising are covered")
        self.score, self.id, self.bytes, self.byte_id = {}, {}, [], {}
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.bytes.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.bytes.append(proto.trainer_spec.unk_surface.encode() if p.type == 2 else b"")
        self.piece = {i: p for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.pieces = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.pieces.add_word(p, (i, len(p)))
        self.pieces.make_automaton()
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.id) or any("\n" in p for p in self.id):
            raise ValueError("a piece crosses the boundary of a unit")
        self.marked, self.bare, self.entries = {}, {}, entries
        self.pairs: dict[int, bool] = {}  # by (first + 1) << 20 | second
        self.size = [len(self.piece.get(i, "")) for i in range(len(self.bytes))]
        self.newline = np.array([self.byte_id[10]], np.int32).tobytes()

    def merged(self, text: str) -> list[str]:
        """The model's own segmentation, by merging: best score first, then leftmost."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for k in range(len(s) - 1):
                score = self.score.get(s[k] + s[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (or stand first, after OUTSIDE)."""
        known = self.pairs.get(a + 1 << 20 | b)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                for x in list(islice(self.pairs, PAIR_ENTRIES // 2)):
                    del self.pairs[x]
            right = self.piece[b]
            if a == OUTSIDE:
                known = self.merged(right) == [right]
            elif self.piece[a] + right in self.id:  # the two would be merged
                known = False
            else:
                known = self.merged(self.piece[a] + right) == [self.piece[a], right]
            self.pairs[a + 1 << 20 | b] = known
        return known

    def _in_one_window(self, unit: str) -> list[int]:
        """The lattice of a unit that fits a window: nothing needs to be committed before its end."""
        back: list[int | None] = [None] * (len(unit) + 1)  # None: a character that no piece holds ends here
        pairs = self.pairs
        for end, (piece, n) in self.pieces.iter(unit):
            end += 1
            if back[end] is None:
                before = back[end - n]
                key = piece if before is None else before + 1 << 20 | piece
                ok = pairs.get(key)
                if ok or ok is None and self.may_follow(OUTSIDE if before is None else before, piece):
                    back[end] = piece
        path, at, size = [], len(unit), self.size
        while at > 0:
            piece = back[at]
            if piece is None:
                path.append(OUTSIDE)
                at -= 1
            else:
                path.append(piece)
                at -= size[piece]
        path.reverse()
        return path

    def lattice(self, unit: str) -> list[int]:
        """Ids of one unit, by the streaming lattice; OUTSIDE stands for a character to be spelt in bytes."""
        if len(unit) <= WINDOW:
            return self._in_one_window(unit)
        out: list[int] = []
        base = 0  # boundary up to which ids are committed
        back: list[int | None] = [OUTSIDE]  # piece that ends at boundary base + k
        size: list[int] = [0]  # its characters
        pairs, looked = self.pairs, WINDOW
        for end, (piece, n) in self.pieces.iter(unit):
            at = end + 1 - base
            while len(back) <= at:
                if back[-1] is None:
                    back[-1], size[-1] = OUTSIDE, 1
                if len(back) == at and at > looked:
                    moved = self._commit(back, size, out)
                    base += moved
                    at -= moved
                    looked = at + WINDOW
                back.append(None)
                size.append(0)
            if back[at] is not None or at < n:
                continue
            before = back[at - n]
            ok = pairs.get(before + 1 << 20 | piece)
            if ok or ok is None and self.may_follow(before, piece):
                back[at], size[at] = piece, n
        while base + len(back) <= len(unit):
            if back[-1] is None:
                back[-1], size[-1] = OUTSIDE, 1
            back.append(None)
            size.append(0)
        if back[-1] is None:
            back[-1], size[-1] = OUTSIDE, 1
        path, at = [], len(back) - 1
        while at > 0:
            path.append(back[at])
            at -= size[at]
        return out + path[::-1]

    def _commit(self, back: list, size: list, out: list[int]) -> int:
        """Commits ids up to the last boundary that all live paths share; returns how far that is."""
        live = set(range(max(0, len(back) - self.longest), len(back)))
        while len(live) > 1:  # replace the furthest by where its piece starts
            far = max(live)
            live.remove(far)
            live.add(far - size[far])
        common = live.pop()
        path, at = [], common
        while at > 0:
            path.append(back[at])
            at -= size[at]
        out.extend(path[::-1])
        if common:
            del back[:common], size[:common]
            size[0] = 0
        return common

    def unit(self, unit: str) -> bytes:
        """Ids of one unit as 32-bit integers."""
        marks = len(unit) - len(unit.lstrip(SPACE))
        if marks > 1:
            found = self._marks(unit, marks)
        else:
            found = self.lattice(unit)
        if OUTSIDE in found:
            ids, at = [], 0
            for i in found:
                if i == OUTSIDE:
                    ids += [self.byte_id[b] for b in unit[at].encode("utf-8", "replace")]
                    at += 1
                else:
                    ids.append(i)
                    at += len(self.piece[i])
            found = ids
        return np.array(found, np.int32).tobytes()

    def _marks(self, unit: str, marks: int) -> list[int]:
        """A run of space marks, whose last one goes with the word if a piece begins with both."""
        rest = self.lattice(unit[marks - 1 :]) if len(unit) > marks else []
        joined = bool(rest) and rest[0] != OUTSIDE and self.piece[rest[0]] != SPACE
        run = marks - 1 if joined else marks
        known = {len(p) for p in self.id if not p.strip(SPACE)}
        s: list[int] = []
        for _ in range(run):  # scores tie: the leftmost pair that is a piece is merged first, so only the last two ever change
            s.append(1)
            while len(s) > 1 and s[-2] + s[-1] in known:
                s[-2:] = [s[-2] + s[-1]]
        return [self.id[SPACE * n] for n in s] + (rest if joined else rest[1:])

    def _cached(self, cache: dict[str, bytes], keys: list[str], prefix: str) -> list[bytes]:
        try:
            return [cache[k] for k in keys]
        except KeyError:
            pass
        if len(cache) > self.entries:  # short units come again most
            for x in sorted(cache, key=len)[self.entries // 2 :]:
                del cache[x]
        out = []
        for k in keys:
            ids = cache.get(k)
            if ids is None:
                ids = self.unit(prefix + k) if prefix or k else b""
                if len(k) <= CACHE_CHARS:
                    cache[k] = ids
            out.append(ids)
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit integers."""
        if not text:
            return b""
        lines = text.split("\n")
        out: list[bytes] = []
        for k, line in enumerate(lines):
            if k:
                out.append(self.newline)
            if "  " in line or SPACE in line or not k and line[:1] == " ":
                escaped = ("" if k else SPACE) + line.replace(" ", SPACE)
                out += self._cached(self.bare, UNITS.findall(escaped), "")
                continue
            words = line.split(" ")
            if k:
                out += self._cached(self.bare, words[:1], "")
                del words[0]
            out += self._cached(self.marked, words, SPACE)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; a byte that is no UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


SCHEMA = "doc_id long, n_tokens int, ids array<int>, decoded_crc32 long, lossless boolean"


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids of every whole text, and what decoding them gives back."""
    bound_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            texts, start = b.column("text").to_pylist(), 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < GROUP_CHARS:
                    size += len(texts[stop] or "")
                    stop += 1
                part = texts[start:stop]
                found = [codec.encode_bytes(t) for t in part]
                back = [codec.decode(np.frombuffer(x, np.int32).tolist()) for x in found]
                offsets = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                arrays = [b.column("doc_id").slice(start, stop - start), pa.array(np.diff(offsets)), ids, pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in back], pa.int64()), pa.array([x == (t or "") for x, t in zip(back, part)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded_crc32", "lossless"])
                start = stop

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of rows with ids (null ids: null text)."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
