"""Operator 4, encoding with sampled segmentations and lossless decoding, over a SentencePiece vocabulary.

A text's lattice has an edge for every piece that matches its bytes, and byte pieces for characters without a piece of
their own.  Forward filtering adds up the weight of all paths to each place; backward sampling walks from the end and
draws each piece with its share of the weight that reaches its end, so whole segmentations are drawn from the exact
distribution p(path) ~ product of piece weights.  A piece's weight is (rank + 1) ** -SHARPNESS, its rank being its
place in the merge order.  Every draw comes from a hash of (seed, row key, byte offset in the text), so a row's
segmentation does not depend on its neighbours, the partition or a retry.

No piece of the vocabulary has a space after another character (checked on loading), so the lattice falls into chunks
at spaces.  Chunks that occur often in a batch are filtered once; sampling runs for all occurrences at once in numpy.
Nothing is normalised: a space is the vocabulary's space mark, a mark in the text itself becomes bytes, and decoding
returns every text as it was.

Cases: null text is empty and has no pieces; a null key counts as 0; repeated rows get the same pieces; very long
texts are cut into no prefixes (a batch holds at least one whole text); an empty table gives none; other columns of any
name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .dart_minhash import _GOLD, _unit, mix
from .shared import text_of

SHARPNESS = 2.0
SEED = 1
#: Bytes of texts, or of decoded texts, handled at once in a task; a batch holds at least one whole text.
BATCH = 1 << 20
_SPACE = 32
#: Spreads the hashes of short windows over the high bits.
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Windows:
    """Hashes of all windows of a byte buffer: sum of byte * base ** place, shifted to place 0 by the base's inverse."""

    def __init__(self, buf: np.ndarray, base: np.uint64):
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(base, len(buf)))])
            self.back = _powers(inverse, len(buf))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.back[start] * _SPREAD


class Vocabulary:
    """Pieces as bytes, their log weights, and tables to find them by window hash."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        by_length: dict[int, list[int]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                if b" " in self.bytes[i].lstrip(b" "):
                    raise ValueError(f"piece {i} has a space after another character")
                by_length.setdefault(len(self.bytes[i]), []).append(i)
        rank = np.arange(n, dtype=float)
        rank[self.byte_id] = n
        self.log_weight = -sharpness * np.log1p(rank)
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.length = np.array([len(x) for x in self.bytes])
        self.start = np.cumsum(self.length) - self.length
        self.tables = []
        for length, ids in sorted(by_length.items()):
            buf = np.frombuffer(b"".join(self.bytes[i] for i in ids), dtype=np.uint8)
            at = np.arange(len(ids)) * length
            h1, h2 = (Windows(buf, b)(at, at + length) for b in _BASES)
            order = np.argsort(h1)
            h1 = h1[order]
            slot = np.full(1 << 18, -1, np.int16)  # the first piece whose hash begins with these 18 bits
            slot[h1[::-1] >> np.uint64(46)] = np.arange(len(h1))[::-1]
            most = int(np.bincount((h1 >> np.uint64(46)).astype(np.int64)).max())
            self.tables.append((length, h1, h2[order], np.array(ids, dtype=np.int32)[order], slot, most))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - length), length)]


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float = SHARPNESS) -> Vocabulary:
    return Vocabulary(path, sharpness)


def _edges(vocab: Vocabulary, buf: np.ndarray, chunk_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and id of every piece that matches inside a chunk; chunk_end: of each byte's chunk."""
    one, two = (Windows(buf, b) for b in _BASES)
    starts, ends, ids = [], [], []
    lead = (buf & 0xC0) != 0x80
    own = np.zeros(len(buf), bool)
    width = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
    at = np.flatnonzero(lead)
    room = (chunk_end - np.arange(len(buf)))[at]
    for length, h1, h2, piece, slot, most in vocab.tables:
        fits = room >= length
        at, room = at[fits], room[fits]
        h = one(at, at + length)
        where = slot[h >> np.uint64(46)]
        could = np.flatnonzero(where >= 0)
        s, h, where = at[could], h[could], where[could].astype(np.int64)
        for _ in range(most - 1):
            where += (h1[where] < h) & (where + 1 < len(h1))
        hit = h1[where] == h
        s, where = s[hit], where[hit]
        hit = h2[where] == two(s, s + length)
        s, where = s[hit], where[hit]
        starts.append(s), ends.append(s + length), ids.append(piece[where])
        own[s[width[s] == length]] = True
    # bytes of the characters that are no piece
    first = np.flatnonzero(lead & ~own)
    s = np.repeat(first, width[first])
    s = s + np.arange(len(s)) - np.repeat(np.cumsum(width[first]) - width[first], width[first])
    return np.concatenate([*starts, s]), np.concatenate([*ends, s + 1]), np.concatenate([*ids, vocab.byte_id[buf[s]]])


def sample(vocab: Vocabulary, texts: list[bytes], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
    """Piece ids of one sampled segmentation of each text."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(buf):
        return [np.zeros(0, np.int32) for _ in texts]
    doc_start = np.cumsum(sizes) - sizes
    # chunks begin with a run of spaces or a text
    begins = (buf == _SPACE) & np.concatenate([[True], buf[:-1] != _SPACE])
    begins[doc_start[sizes > 0]] = True
    c_start = np.flatnonzero(begins)
    c_end = np.append(c_start[1:], len(buf))
    c_len = c_end - c_start
    doc = np.searchsorted(doc_start + sizes, c_start, side="right")
    key = mix(Windows(buf, _BASES[0])(c_start, c_end)) + c_len.astype(np.uint64)
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    same = np.arange(len(buf)) + np.repeat(c_start[first][kind] - c_start, c_len)
    if (wrong := buf[same] != buf).any():  # two chunks with one hash: the later ones are kinds of their own
        other = np.unique(np.searchsorted(c_start, np.flatnonzero(wrong), side="right") - 1)
        kind[other] = len(first) + np.arange(len(other))
        first = np.append(first, other)
    # the distinct chunks, one after the other
    u_len = c_len[first]
    u_start = np.cumsum(u_len) - u_len
    which = np.repeat(np.arange(len(first)), u_len)
    u_buf = buf[np.arange(len(which)) + np.repeat(c_start[first] - u_start, u_len)]
    s, e, ids = _edges(vocab, u_buf, (u_start + u_len)[which])
    # nodes: a chunk of n bytes has n + 1; edges in order of their end's place in the chunk, then of the end
    src, dst = s + which[s], e + which[s]
    step = e - u_start[which[s]]
    order = np.lexsort((dst, step))
    src, dst, ids, step = src[order], dst[order], ids[order], step[order]
    alpha = np.full(len(u_buf) + len(first), -np.inf)
    alpha[u_start + np.arange(len(first))] = 0.0
    share = vocab.log_weight[ids]
    bounds = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        score = alpha[src[a:b]] + share[a:b]
        heads = np.flatnonzero(np.concatenate([[True], dst[a + 1 : b] != dst[a : b - 1]]))
        top = np.maximum.reduceat(score, heads)
        spread = np.repeat(top, np.diff(np.append(heads, b - a)))
        total = top + np.log(np.add.reduceat(np.exp(score - spread), heads))
        alpha[dst[a + heads]] = total
    share = np.exp(alpha[src] + share - alpha[dst])
    # by end: edges of a node stand together, their shares add up to 1; node number + share so far is increasing
    order = np.lexsort((src, dst))
    src, dst, ids, share = src[order], dst[order], ids[order], share[order]
    heads = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
    counts = np.diff(np.append(heads, len(dst)))
    run = np.cumsum(share)
    run = run - np.repeat(run[heads] - share[heads], counts)
    last = heads + counts - 1
    run[last] = 1.0
    ladder = dst + np.minimum(run, 1.0)
    # all occurrences walk back from their chunk's end
    with np.errstate(over="ignore"):
        row_seed = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed) * _GOLD)[doc]
    head_node = (u_start + np.arange(len(first)))[kind]
    node = head_node + c_len
    offset = c_start - doc_start[doc]
    live = np.argsort(kind, kind="stable")  # occurrences of a kind side by side, so that they read the same edges
    n_pieces = np.zeros(len(kind), np.int64)
    walks = []
    while len(live):
        with np.errstate(over="ignore"):
            place = (offset[live] + node[live] - head_node[live]).astype(np.uint64)
            u = _unit(mix(row_seed[live] + place * _GOLD))
        edge = np.minimum(np.searchsorted(ladder, node[live] + np.maximum(u, 1e-12), side="left"), len(ladder) - 1)
        walks.append((live, ids[edge]))
        n_pieces[live] += 1
        node[live] = src[edge]
        live = live[src[edge] != head_node[live]]
    ends = np.cumsum(n_pieces)
    out = np.empty(ends[-1], np.int32)
    for nth, (who, piece) in enumerate(walks):
        out[ends[who] - 1 - nth] = piece
    per_doc = np.bincount(doc, weights=n_pieces, minlength=len(texts)).astype(np.int64)
    return np.split(out, np.cumsum(per_doc)[:-1])


def _portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about BATCH."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, seed: int, sharpness: float) -> Iterator[pa.RecordBatch]:
    """doc_id, text, pieces and ids_crc32 of batches of doc_id and text."""
    vocab = vocabulary(path, sharpness)
    for b in batches:
        text = b.column("text").cast(pa.binary())
        keys = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        for a, z in _portions(pc.binary_length(text).to_numpy(zero_copy_only=False)):
            ids = sample(vocab, text[a:z].to_pylist(), keys[a:z], seed)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[a:z], b.column("text")[a:z], _lists(ids), pa.array(crc, pa.int64())], names=["doc_id", "text", "pieces", "ids_crc32"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """batches with the column decoded, the text of the column pieces."""
    vocab = vocabulary(path)
    for b in batches:
        counts = b.column("pieces").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = b.column("pieces").flatten().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(vocab.length[ids])])[first]
        for a, z in _portions(np.diff(total)):
            buf = vocab.decode(ids[first[a] : first[z]]).tobytes()
            ends = total[a : z + 1] - total[a]
            text = pa.array([buf[m:n] for m, n in zip(ends[:-1], ends[1:], strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.slice(a, z - a).columns, text], names=[*b.schema.names, "decoded"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def encode(docs: DataFrame, path: str | None = None, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, text, pieces (ids) and ids_crc32 (of little-endian unsigned 32-bit ids) for every row of docs."""
    path = path or model_path()
    return _keyed(docs).mapInArrow(lambda batches: _encoded(batches, path, seed, sharpness), "doc_id long, text string, pieces array<int>, ids_crc32 long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with the column decoded, the text of its pieces."""
    path = path or model_path()
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(lambda batches: _decoded(batches, path), schema)


def pieces_query(docs: DataFrame, path: str | None = None, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether decoding gives the text back, for every row.

    Encoding and decoding run in one Python worker, so that neither texts nor pieces travel back to the JVM.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _decoded(_encoded(batches, path, seed, sharpness), path):
            n = b.column("pieces").value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, b.column("ids_crc32"), pc.equal(b.column("decoded"), b.column("text"))], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return _keyed(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
