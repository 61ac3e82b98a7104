"""Operator 7: token ids in binary blocks (``rangecoder``) in ascending document order, and their reader.

Documents are range-partitioned and sorted by id; every task encodes its run of documents and writes blocks of about
``BLOCK_IDS`` ids (a block ends with a document).  The store is a folder of Parquet files with one row per block:
partition, sequence, documents, ids and the block's bytes.  Offsets over the whole store come from block totals, so the
reader needs nothing but the blocks.

Every ASCII border between a letter and punctuation is a word border of the tokenizer, as is white space, so
ids are looked up per distinct piece (letters folded to lower case, as the tokenizer does); a slice that holds a special
token's opening is encoded without splitting or folding.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows that share an id are kept
side by side, in the order of a hash of their text; an empty table is a store without blocks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rangecoder import decode_block, encode_block
from .textkit import SpanHasher, text_slices, word_spans
from .wordcache import WordIds
from .workspace import Workspace

BLOCK_IDS = 1 << 20
END_ID = 2
BLOCKS = "part int, seq int, docs long, ids long, null_id boolean, block binary"

_letter = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_mark = np.array([33 <= i < 127 and not chr(i).isalnum() and i != ord("'") for i in range(256)])
_encoders: dict[str, WordIds] = {}


def _plain_letters(tokenizer) -> dict[str, str]:
    """ASCII and Latin-1 letters with what the tokenizer's own normalizer and pre-tokenizer make of them.

    These letters neither combine nor change with their neighbours, and a run of them is one word of the model.
    """
    out = {}
    for c in map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100))):
        if c.isalpha() and len(c.lower()) == 1:
            pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c))
            if len(pieces) == 1:
                out[c] = pieces[0][0]
    return out


def _encoder(path: str) -> WordIds:
    """One tokenizer with its table of known pieces per Python worker."""
    if path not in _encoders:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)

        model = tokenizer.model
        #: Line breaks part the words of a batch; a character that is no plain letter becomes NUL.
        known = defaultdict(lambda: "\0", {ord(c): to for c, to in _plain_letters(tokenizer).items()}) | {ord("\n"): "\n"}

        def encode(words: list[bytes]) -> list[list[int]]:
            """Words of plain letters go to the model as the tokenizer would hand them over; the rest takes all its steps."""
            plain = b"\n".join(words).decode().translate(known).split("\n")
            rest = [i for i, word in enumerate(plain) if "\0" in word or not word]
            for i in rest:
                plain[i] = ""
            out = [[t.id for t in model.tokenize(word)] if word else [] for word in plain]
            if rest:
                for i, e in zip(rest, tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
                    out[i] = e.ids
            return out

        _encoders[path] = WordIds(encode, bits=21, pool=1 << 23)
    return _encoders[path]


def _pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut further where an ASCII letter meets ASCII punctuation other than the apostrophe."""
    start, end, doc = word_spans(data, offs)
    if len(start) == 0:
        return start, end, doc
    letter, mark = _letter[data], _mark[data]
    cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    cut = cut[~np.isin(cut, offs)] if len(offs) > 2 else cut
    if len(cut):
        of = np.searchsorted(start, cut, "right") - 1
        start = np.sort(np.concatenate((start, cut)), kind="stable")
        end = np.sort(np.concatenate((end, cut)), kind="stable")
        doc = np.sort(np.concatenate((doc, doc[of])), kind="stable")
    return start, end, doc


def encode_texts(texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each closed by the end id; ids per text)."""
    encoder = _encoder(path)
    ids, sizes = [], []
    for lo, hi, data, offs in text_slices(texts, 4 << 20):
        special = b"<|" in data.tobytes()
        start, end, doc = word_spans(data, offs) if special else _pieces(data, offs)
        n = hi - lo
        found, each = (encoder(data, start, end, SpanHasher(data, fold_case=not special)(start, end))
                       if len(start) else (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        size = np.bincount(doc, each, n).astype(np.int64)
        out = np.empty(len(found) + n, np.uint32)
        ends = np.cumsum(size + 1)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = found
        out[ends - 1] = END_ID
        ids.append(out)
        sizes.append(size + 1)
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(sizes)


def write_store(docs: DataFrame, path: str, ws: Workspace, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of all documents as a written table (``BLOCKS``)."""
    parts = max(8, docs.rdd.getNumPartitions())
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, count = [], 0

        def block():
            nonlocal held, count, seq
            keys, sizes, ids = (np.concatenate(c) for c in zip(*held))
            out = [part, seq, len(keys), len(ids), was_null, encode_block(keys, sizes, ids)]
            held, count, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                names=["part", "seq", "docs", "ids", "null_id", "block"])

        was_null = False
        for batch in batches:
            key = batch.column(0)
            nulls = key.is_null().to_numpy(zero_copy_only=False)
            values = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, sizes = encode_texts(batch.column(1), path)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(values):
                if held and nulls[lo] != was_null:        # null ids come first and have blocks of their own
                    yield block()
                was_null = bool(nulls[lo])
                begin = int(ends[lo] - sizes[lo])
                hi = int(np.searchsorted(ends, begin + block_ids - count, "left")) + 1
                hi = max(lo + 1, min(hi, len(values)))
                if was_null:
                    hi = min(hi, int(nulls.sum()))
                held.append((values[lo:hi], sizes[lo:hi], ids[begin:int(ends[hi - 1])]))
                count += int(ends[hi - 1]) - begin
                lo = hi
                if count >= block_ids:
                    yield block()
        if held:
            yield block()

    return ws.table(ordered.mapInArrow(run, BLOCKS), "store")


def read_store(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (blocks.groupBy("part").agg(F.sum("ids").alias("held"))          # one row per task that wrote
             .select("part", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("part_start")))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.select("part", "seq", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("seq_start"))
              .join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("begin")))
    placed = blocks.join(starts, ["part", "seq"]).select("begin", "null_id", "block")

    def run(batches):
        for batch in batches:
            for begin, null, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys, sizes, ids = decode_block(raw.as_py())
                ends = np.cumsum(sizes)
                data = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=np.full(len(keys), null)), pa.array(ends - sizes + begin, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
