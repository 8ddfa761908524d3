"""Packing documents into fixed-length sequences: minimum bin slack by bitset subset sums.

A document's ids (and an end id) are cut into full sequences and one rest. The rests are dealt by a hash into buckets
of bounded size, and each bucket is packed alone. The longest rest opens a window; a subset-sum table, kept as the
bits of one integer per length, finds the multiset of the remaining lengths that comes closest to the window's
capacity, and walking back through the tables gives the counts. A multiset that fills its window is used as often as
the counts allow. Where the closest multiset leaves slack, it is used too, and the slack is filled by cutting it off
the longest rest that is left, whose remainder goes back to the others. Of the last window of a bucket, for which
nothing is left to cut, the pieces are laid end to end and cut into sequences whose lengths are powers of two. So
nothing is padded, and a rest is cut only where no multiset could have filled.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed one by one, and dealt
over the buckets by the input's partition too, so that a row of a million copies makes no bucket of its own; ties
between equal lengths go by id and start; an empty table gives an empty result; extra columns are ignored; a text of any
length is tokenized whole, in a worker's memory.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import batch_of, rows_of, table

CAPACITY = 4096
END_ID = 2
#: Documents in a bucket, on average.
BUCKET = 8192
TOKENIZER = "word_bpe_49k.json"
#: Pieces in a generation of those that a worker keeps with their ids, and the longest of them.
KEPT_PIECES, LONG_PIECE = 300_000, 64
#: Texts whose lower case is each letter's own, in which nothing composes and white space is plain.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\xa1-\u012f\u2010-\u2027]*")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: What the tokenizer takes for a word, in a plain text in lower case.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: How a byte-level vocabulary writes the bytes that aren't visible characters.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}


class Pieces(dict):
    """{piece: its ids}, filled as pieces are looked up, in two generations.

    When the young one is full it becomes the old one, from which pieces in use come back.
    """

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.old = tokenize, {}

    def __missing__(self, piece: str) -> bytes:
        x = self.old.get(piece)
        if x is None:
            ids = [t.id for t in self.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARS))]
            x = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = x
        return x


#: The rules of a tokenizer whose plain texts are split here: what its file says of them.
SPLIT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def splits_by_piece(path: str) -> bool:
    """Whether the tokenizer of this file has the rules that PIECE and PLAIN are made for."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (rules.get("normalizer") == SPLIT["normalizer"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]
            and all("<|" in x["content"] for x in rules["added_tokens"]) and parts[0].get("pattern") == {"Regex": SPLIT["split"]} and not parts[1].get("add_prefix_space") and rules["model"]["type"] == "BPE")


class WordTokenizer:
    """ids of texts for a tokenizer's file.

    Where it lowers case, splits by PIECE, drops white space and never joins over pieces, plain texts are split here, and
    their pieces looked up; texts beyond Latin letters, or with what may be a special token, and all texts of other
    tokenizers, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.pieces = Pieces(self.model.model.tokenize)
        self.by_piece = splits_by_piece(path)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_piece or "<|" in text or not PLAIN.fullmatch(text):
            return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def closest(lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The multiset of lengths with the largest sum of at most capacity, as (sum, {length: count}).

    Bit s of the table is set if some multiset has the sum s; lengths are tried in the order given until one fits.
    """
    mask, bits, layers = (1 << (capacity + 1)) - 1, 1, []
    for length in lengths:
        left = min(counts[length], capacity // length)
        if left <= 0:
            continue
        layers.append((length, bits))
        step = 1
        while left > 0:
            use = min(step, left)
            bits |= (bits << (use * length)) & mask
            left, step = left - use, step * 2
        if bits >> capacity & 1:
            break
    best = at = bits.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(layers):
        while not before >> at & 1:
            at -= length
            chosen[length] = chosen.get(length, 0) + 1
    return best, chosen


def windows(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int, int, int]]:
    """(multiset, windows, slack, donor): the closest multisets, opened by the longest length that is left.

    Slack is cut off a piece of the donor's length, whose remainder counts from then on; 0 if nothing is left to cut.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        total, chosen = closest(sorted((n for n, c in counts.items() if c), reverse=True), counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        slack = capacity - longest - total
        times = 1 if slack else min(counts[n] // c for n, c in chosen.items())
        for n, c in chosen.items():
            counts[n] -= c * times
        donor = max((n for n, c in counts.items() if c), default=0) if slack else 0  # longer than the slack, or it were chosen
        if donor:
            counts[donor] -= 1
            counts[donor - slack] = counts.get(donor - slack, 0) + 1
        counts = {n: c for n, c in counts.items() if c}
        yield chosen, times, slack, donor


def pack_bucket(pieces: pd.DataFrame, capacity: int = CAPACITY, width: str = "<u2") -> pd.DataFrame:
    """Sequences for the pieces of one bucket. ids: of the rests only, of the width; ids_crc32: of whole pieces."""
    pieces = pieces.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
    length, start = pieces["length"].to_numpy(), pieces["start"].to_numpy()
    out: list[tuple[int, int, int, int, int]] = []  # row, from, length, sequence, offset
    sequence = 0
    for row in np.flatnonzero(length == capacity):
        out.append((row, 0, capacity, sequence, 0))
        sequence += 1
    rests: dict[int, list[tuple[int, int]]] = {}  # by length: row, from
    for row in np.flatnonzero(length < capacity)[::-1]:
        rests.setdefault(int(length[row]), []).append((row, 0))
    for chosen, times, slack, donor in windows({n: len(x) for n, x in rests.items()}, capacity):
        for _ in range(times):
            offset, window = 0, []
            for n, c in chosen.items():
                for _ in range(c):
                    window.append((*rests[n].pop(), n, offset))
                    offset += n
            if donor:
                row, at = rests[donor].pop()
                window.append((row, at, slack, offset))
                rests.setdefault(donor - slack, []).append((row, at + slack))
            if donor or not slack:
                out += [(row, at, n, sequence, offset) for row, at, n, offset in window]
                sequence += 1
                continue
            ends = np.cumsum([1 << b for b in range(capacity.bit_length() - 1, -1, -1) if offset >> b & 1]).tolist()
            begins = [0, *ends]
            k = 0
            for row, at, n, offset in window:
                while n:
                    use = min(n, ends[k] - offset)
                    out.append((row, at, use, sequence + k, offset - begins[k]))
                    at, n, offset = at + use, n - use, offset + use
                    k += offset == ends[k]
            sequence += len(ends)
    row, source, size, seq, offset = (np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 5
    result = pieces.iloc[row].reset_index(drop=True)
    crc = result["ids_crc32"].to_numpy(np.int64).copy()
    for i in np.flatnonzero(size != length[row]):
        crc[i] = zlib.crc32(np.frombuffer(result["ids"][i], width).astype("<u4")[source[i]:source[i] + size[i]].tobytes())
    bucket = result["bucket"].to_numpy(np.int64) if len(result) else np.empty(0, np.int64)
    return pd.DataFrame({"doc_id": result["doc_id"], "start": start[row] + source, "length": size, "ids_crc32": crc,
                         "doc_tokens": result["doc_tokens"], "sequence_id": (bucket << 32) + seq, "offset": offset})


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, bucket: int = BUCKET) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: of the tokenizer's file, at the same place on every executor.
    """
    buckets = max(1, -(-docs.count() // bucket))
    text = F.coalesce("text", F.lit(""))
    dealt = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", text, F.spark_partition_id()), F.lit(buckets)).alias("bucket"))
    width = "<u2" if max(end_id + 1, tokenizer(path).model.get_vocab_size(with_added_tokens=True)) <= 1 << 16 else "<u4"
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "bucket", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for rows in rows_of(batches):
            out = []
            for doc_id, text, to in rows:
                ids = encode(text) + end
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    part = ids[4 * a:4 * (a + capacity)]
                    rest = np.frombuffer(part, "<u4").astype(width).tobytes() if len(part) < 4 * capacity else None
                    out.append((doc_id, to, a, len(part) // 4, zlib.crc32(part), n, rest))
                if len(out) >= 4096:
                    yield batch_of(out, schema)
                    out = []
            yield batch_of(out, schema)

    cut = dealt.mapInArrow(pieces, "doc_id long, bucket long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return cut.groupBy("bucket").applyInPandas(lambda x: pack_bucket(x, capacity, width), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
