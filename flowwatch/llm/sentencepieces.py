"""Operator 2: SentencePiece encoding and decoding by a shared-prefix Viterbi over a trie of marked words.

A text gets the word mark in place of each blank and one in front.  No piece has a mark inside or a line feed, so a text
splits into marked words that are encoded on their own.  The distinct words of a batch are sorted, which lays them out as
a trie in depth-first order; the traversal keeps one forward state per prefix length, and the next word starts from the
states of the prefix that it shares.  The forward state of a prefix is the last piece of its best path; a path
extends by a piece only if merging by piece scores would leave the two pieces apart, which makes the best path unique and equal to
the model's own merge order.  Characters outside the vocabulary become byte pieces.

Decoding joins the pieces' bytes, turns marks into blanks and drops the one in front.

Defined results: null and empty texts have no ids and decode to the empty text; a mark character in a text
decodes to a blank, as the model defines; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SpanHasher, bounds, text_slices
from .wordcache import WordIds, gather_spans

MARK = "▁"
BLANK, FEED = 0x20, 0x0A


class Pieces:
    """The vocabulary of a model file: ids, scores and bytes of its pieces, and which neighbours stay apart."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        self._apart: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by repeatedly joining the neighbours with the best-scored union, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            known = self._apart[key] = self.merged(left + right) == [left, right]
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of every word; the words may come in any order."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        states: list[str] = [""]            # states[k]: last piece of the best path over the first k characters
        before = ""
        ids, apart, longest = self.ids, self.apart, self.longest
        for w in order:
            word = words[w]
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1:]
            for k in range(shared + 1, len(word) + 1):
                last = ""
                for a in range(max(0, k - longest), k):
                    piece = word[a:k]
                    if piece in ids and states[a] is not None and (a == 0 or apart(states[a], piece)):
                        if a == 0 and len(piece) > 1 and self.merged(piece) != [piece]:
                            continue        # a piece that its own characters do not merge into
                        last = piece
                        break
                states.append(last or word[k - 1])
            path, k = [], len(word)
            while k:
                piece = states[k]
                if piece in ids:
                    path.append(ids[piece])
                else:
                    path.extend(self.byte_id[c] for c in reversed(piece.encode()))
                k -= len(piece)
            path.reverse()
            out[w] = path
            before = word
        return out


_loaded: dict[str, tuple[Pieces, WordIds, np.ndarray, np.ndarray]] = {}


def _load(path: str):
    """Model, table of known words, and the pieces' bytes in one array, once per Python worker."""
    if path not in _loaded:
        pieces = Pieces(path)

        def encode(words: list[bytes]) -> list[list[int]]:
            return pieces.encode_words([w.decode().replace(" ", MARK) for w in words])

        pool = np.frombuffer(b"".join(pieces.bytes), np.uint8)
        _loaded[path] = pieces, WordIds(encode, bits=20, pool=1 << 22), pool, bounds(np.array([len(b) for b in pieces.bytes]))
    return _loaded[path]


def marked_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a blank in front of each non-empty text, its offsets, word starts, word ends, text of each word)."""
    filled = np.flatnonzero(np.diff(offs) > 0)
    data = np.insert(data, offs[filled], BLANK)
    offs = offs + np.concatenate(([0], np.cumsum(np.diff(offs) > 0)))
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return data, offs, e, e, e
    blank, feed = data == BLANK, data == FEED
    begins = np.zeros(len(data), bool)
    begins[1:] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    begins[offs[:-1][np.diff(offs) > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    return data, offs, start, end, np.searchsorted(offs, start, "right") - 1


def encode_texts(texts, path: str):
    """Yields per slice (first row, end row, marked bytes, their offsets, ids, ids per text)."""
    _, table, _, _ = _load(path)
    for lo, hi, data, offs in text_slices(texts):
        data, offs, start, end, doc = marked_words(data, offs)
        if len(start):
            ids, each = table(data, start, end, SpanHasher(data)(start, end))
        else:
            ids, each = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield lo, hi, data, offs, ids, np.bincount(doc, each, hi - lo).astype(np.int64)


def decode_ids(ids: np.ndarray, sizes: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with the blank in front still on, offsets)."""
    _, _, pool, piece_bounds = _load(path)
    data, ends = gather_spans(pool, piece_bounds[:-1][ids], piece_bounds[1:][ids])
    return data, ends[bounds(sizes)]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array of ids per text added."""
    docs = docs.drop(out)                                      # a column of that name gives way
    schema = docs.withColumn(out, F.array().cast("array<int>")).schema

    def run(batches):
        for batch in batches:
            for lo, hi, _, _, ids, sizes in encode_texts(batch.column(batch.schema.get_field_index(text)), path):
                part = batch.slice(lo, hi - lo)
                column = pa.ListArray.from_arrays(pa.array(bounds(sizes), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with the text of an array of ids added; a null array is the empty text."""
    docs = docs.drop(out)
    schema = docs.withColumn(out, F.lit("")).schema

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = []
            for one in lists:
                flat = np.array(one or [], np.int64)
                data, _ = decode_ids(flat, np.array([len(flat)]), path)
                texts.append(data.tobytes().decode(errors="replace")[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_crc32, same): every text encoded and decoded again.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers, ``text_crc32`` over the decoded text's bytes; ``same`` says
    that the decoded bytes are those of the text.
    """
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs, ids, sizes in encode_texts(batch.column(1), path):
                back, back_offs = decode_ids(ids, sizes, path)
                whole = np.array_equal(back, data)
                raw_ids, raw = memoryview(ids.astype("<u4")).cast("B"), back.tobytes()
                cut = (4 * bounds(sizes)).tolist()
                at = back_offs.tolist()
                crc_ids = [zlib.crc32(raw_ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                crc = [zlib.crc32(raw[a + 1:b]) if b > a else 0 for a, b in zip(at[:-1], at[1:])]
                src = data.tobytes() if not whole else b""
                same = [whole or src[a:b] == raw[c:d] for a, b, c, d in zip(offs[:-1], offs[1:], at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(crc_ids, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_crc32", "text_crc32", "same"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, same boolean")
