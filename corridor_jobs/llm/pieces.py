"""SentencePiece encoding and decoding that keeps, for every piece, the bytes of the source it came from.

The normaliser takes, at each place, the longest prefix that the model's compiled character map knows (a double-array
trie; none in an identity model) and records where in the source each normalised character came from. White space
becomes U+2581. As no piece of a supported model has U+2581 after another character, no merge crosses the start of a
run of them: the text is cut there, each distinct chunk is normalised and merged once and remembered, and piece spans are
those of the chunk moved to its place. Where no piece mixes letters with other characters, chunks end between these too.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, text_batches, whole

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Chunks remembered by each Python worker, in two generations of which the older is dropped when the newer is full.
REMEMBERED = 80_000


def _one_by_one(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1  # each byte that decodes to nothing becomes one U+FFFD


codecs.register_error("piece_bytes", _one_by_one)


def _width(c: str) -> int:
    """Bytes of a character."""
    return 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4


class CharsMap:
    """A compiled character map: 4 bytes of trie size, a double array, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that data has at a place."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Model:
    """A BPE model, as encoder and decoder. data: the content of its file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto.FromString(data)
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep white space, escaped and as a prefix, are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in m.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.map, self.dummy = CharsMap(spec.precompiled_charsmap), spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has white space after other characters; chunks would not be independent")
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_ids = [byte[b] for b in range(256)]
        unknown = m.trainer_spec.unk_surface.encode()
        self.raw = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else unknown if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" for p in m.pieces]
        self.spaced = {i for p, i in self.ids.items() if p[0] == SPACE}
        self.text_of_id = [str(i) for i in range(len(m.pieces))]
        bare = [p.lstrip(SPACE) for p in self.ids]
        letter = re.compile(r"[^\W\d_]")
        odd = sorted({c for p in bare if 0 < len(kinds := letter.findall(p)) < len(p) for c in kinds})
        out = re.escape("".join(odd))  # characters in pieces that mix letters with others count as others
        letters = re.compile(rf"[^\W\d_{out}]+")
        apart = all(letters.fullmatch(p) or not letters.search(p) for p in bare)
        run = rf"(?:{letters.pattern}|(?:[^\w {SPACE}]|[\d_{out}])+)" if apart else f"[^ {SPACE}]+"
        self.cut = re.compile(f"[ {SPACE}]*{run}|[ {SPACE}]+")
        self.seen: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def normalise(self, text: str, prefix: bool) -> tuple[str, Sequence[int], Sequence[int]]:
        """The normalised text, and for each of its characters the source bytes [start, end)."""
        if not self.map.units:
            if text.isascii():
                edge = range(len(text) + 1)
            else:
                edge = [0, *accumulate(map(_width, text))]
            norm, starts, ends = text.replace(" ", SPACE), edge[:-1], edge[1:]
            return (SPACE + norm, [0, *starts], [0, *ends]) if prefix and text else (norm, starts, ends)
        out, starts, ends, data, at = [], [], [], text.encode(), 0
        if prefix and text:
            out, starts, ends = [SPACE], [0], [0]
        while at < len(data):
            if hit := self.map.longest(data, at):
                n, piece = hit[0], hit[1].decode()
            else:
                b = data[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                piece = data[at : at + n].decode()
            for c in piece:
                out.append(SPACE if c == " " else c)
                starts.append(at)
                ends.append(at + n)
            at += n
        return "".join(out), starts, ends

    def merge(self, s: str) -> list[str]:
        """Byte-pair merges: always the pair whose piece scores best, the leftmost of equals."""
        score, parts = self.score, list(s)
        if len(parts) <= 48:
            get, none = score.get, float("-inf")
            pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
            while pairs and (best := max(pairs)) != none:
                i = pairs.index(best)
                both = parts[i] = parts[i] + parts.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] + both, none)
                if i < len(pairs):
                    pairs[i] = get(both + parts[i + 1], none)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-x, i, both) for i in range(n - 1) if (x := score.get(both := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := score.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-x, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def chunk(self, text: str, prefix: bool) -> tuple[bytes, bytes, bytes, int]:
        """A chunk normalised and merged: its ids, the source bytes [starts, ends) of each id, counted from the chunk's
        first, all packed as 32-bit integers, and the number of source bytes. The bytes that a character falls back to
        share its span."""
        norm, starts, ends = self.normalise(text, prefix)
        merged = self.merge(norm)
        out = list(map(self.ids.get, merged))
        edge = list(accumulate(map(len, merged), initial=0))
        begin, end = [starts[k] for k in edge[:-1]], [ends[k - 1] for k in edge[1:]]
        if None in out:  # pieces that are no pieces of the model fall back to bytes
            size = [1 if i is not None else len(p.encode()) for i, p in zip(out, merged, strict=True)]
            out = [x for i, p in zip(out, merged, strict=True) for x in ([i] if i is not None else [self.byte_ids[b] for b in p.encode()])]
            begin, end = ([x for x, n in zip(xs, size, strict=True) for _ in range(n)] for xs in (begin, end))
        return array("i", out).tobytes(), array("i", begin).tobytes(), array("i", end).tobytes(), ends[-1]

    def parts(self, text: str) -> list[str]:
        """The text in chunks that no merge crosses; whole where the map may look across them."""
        return self.cut.findall(text) if not self.map.units else [text] if text else []

    def chunks(self, text: str, remembered: int = REMEMBERED) -> list[tuple]:
        """What chunk() gives for each part of the text."""
        parts = self.parts(text)
        if not parts:
            return []
        if len(self.seen) > remembered:
            self.seen, self.older = {}, self.seen
        seen, get, older = self.seen, self.seen.get, self.older
        out = [self.chunk(parts[0], self.dummy)]
        for p in parts[1:]:
            e = get(p)
            if e is None:
                e = older.get(p) or self.chunk(p, False)
                if len(p) <= 64:
                    seen[p] = e
            out.append(e)
        return out

    def encode(self, text: str) -> list[int]:
        return ids_of(self.chunks(text)).tolist()

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """Start and end, in bytes of the source, of every piece that encode() gives."""
        starts, ends = spans_of(self.chunks(text))
        return starts.tolist(), ends.tolist()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.dummy and ids and ids[0] in self.spaced:
            raw = raw[1:]
        return raw.decode("utf-8", "piece_bytes")


def ids_of(chunks: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join([e[0] for e in chunks]), dtype=np.int32)


def spans_of(chunks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of all pieces: those of each chunk, moved to its place."""
    size = np.array([e[3] for e in chunks], dtype=np.int64)
    moved = np.repeat((np.cumsum(size) - size).astype(np.int32), np.array([len(e[0]) for e in chunks], dtype=np.int64) // 4)
    return tuple(np.frombuffer(b"".join([e[k] for e in chunks]), dtype=np.int32) + moved for k in (1, 2))


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What encode() can return, by column.
KINDS = {
    "pieces": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "starts": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "ends": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
    "spans_sha256": (T.StringType(), pa.string()),
}
#: Rows that a worker turns into one output batch.
ROWS = 64


def encode(docs: DataFrame, outputs: list[str], path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """The kept columns of every document, then the outputs asked for: pieces (ids), starts and ends (source bytes of
    each), decoded (the text that the ids decode to), n_tokens, and digests of ids (in decimals, with commas), decoded
    text, and spans (starts, then ends, each in four bytes, the lowest first).

    Narrow: no shuffle, one pass over the text. Null or empty text has no pieces and decodes to the empty text. Very
    long texts are encoded whole. Columns not in keep are ignored. An output with the name of a kept column is an error.
    Repeated rows are encoded each; an empty table gives no rows. remembered bounds the chunks that a worker keeps (about
    0.7 kB each, both generations); it changes the time alone.
    """
    if clash := {*outputs} & {*keep}:
        raise ValueError(f"outputs and kept columns share names: {sorted(clash)}")
    path = path or model_path()
    text_batches(docs.sparkSession)
    src = docs.select(*keep, whole(text_col).alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(k, KINDS[k][0]) for k in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                made = [_document(model, text.as_py(), outputs, remembered) for text in part.column(len(keep))]
                columns = [pa.array([m[k] for m in made], type=KINDS[k][1]) for k in outputs]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=[*keep, *outputs])

    return src.mapInArrow(run, schema)


def _document(model: Model, text: str, outputs: list[str], remembered: int = REMEMBERED) -> dict:
    chunks = model.chunks(text, remembered)
    ids = ids_of(chunks)
    made: dict = {"pieces": ids, "n_tokens": len(ids)}
    if {"starts", "ends", "spans_sha256"} & {*outputs}:
        starts, ends = spans_of(chunks)
        made |= {"starts": starts, "ends": ends, "spans_sha256": hashlib.sha256(starts.astype("<i4").tobytes() + ends.astype("<i4").tobytes()).hexdigest()}
    if "ids_sha256" in outputs:
        made["ids_sha256"] = hashlib.sha256(",".join(map(model.text_of_id.__getitem__, ids.tolist())).encode()).hexdigest()
    if {"decoded", "decoded_sha256"} & {*outputs}:
        decoded = model.decode(ids.tolist())
        made |= {"decoded": decoded, "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
    return made


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"], remembered=400_000)
