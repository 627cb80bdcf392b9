"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers with the word that follows. Where no piece holds a marker after another
character (checked on the model), no merge crosses from one chunk to the next, so a text's ids are its chunks' ids in
order. Each task keeps a table of the distinct chunks it has met, has the library segment each new one once, and
joins ids and decoded strings back by position. The table is bounded: beyond `most` chunks or `most_chars` characters in
them it starts anew, which costs time and changes nothing. There is no shuffle.

Defined results: null and empty texts have no ids and decode to the empty string; repeated rows give equal rows; an
empty table gives an empty result; texts are encoded whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, id_and_text, list_column, map_arrow

MARK = "▁"
_chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
#: Texts of about so many characters are joined at once.
_BLOCK = 1 << 20


def marked_words(text: str) -> list[str]:
    """The chunks of a text, each without its first marker."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in _chunks(MARK + text.replace(" ", MARK))]


class _Numbers(dict):
    """Numbers for chunks in order of appearance; new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class ChunkTable:
    """Distinct chunks with their ids and, with `decoded`, their decoded strings."""

    def __init__(self, model: bytes, most: int = 800_000, most_chars: int = 8 << 20, decoded: bool = True):
        import sentencepiece

        self.decoded = decoded

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.most, self.most_chars = most, most_chars
        if any(MARK in self.lib.id_to_piece(i).lstrip(MARK) for i in range(self.lib.get_piece_size())):
            raise ValueError("this model has pieces that cross whitespace markers; its texts can't be cut into chunks")
        self.lone = self.lib.encode("a ")[len(self.lib.encode("a")) :]
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.chars = 0
        self.said: list[str] = []
        self.flat, self.start, self.count = array("i"), array("q"), array("i")

    def segment(self) -> None:
        """Ids and strings of the chunks that the index has numbered since the last call."""
        new, self.index.new = self.index.new, []
        if not new:
            return
        self.chars += sum(map(len, new))
        ids = self.lib.encode([w.replace(MARK, " ") for w in new], num_threads=1)
        ids = [x if w else self.lone for w, x in zip(new, ids)]
        if self.decoded:
            self.said += [w if w == t else t for w, t in zip(new, self.lib.decode(ids))]
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        self.start.frombytes((len(self.flat) + np.cumsum(n, dtype=np.int64) - n).tobytes())
        self.count.frombytes(n.tobytes())
        self.flat.extend(chain.from_iterable(ids))

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > self.most or self.chars > self.most_chars:
            self.clear()
        get = self.index.__getitem__
        out = [np.fromiter(map(get, words), np.int32, len(words)) for words in texts]
        self.segment()
        return out

    def counts(self, texts: list[list[str]]) -> np.ndarray:
        """Number of ids of each text."""
        coded = self.codes(texts)
        count = np.frombuffer(self.count, np.int32) if self.count else np.zeros(0, np.int32)
        return np.array([count[c].sum(dtype=np.int64) for c in coded], np.int64)

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, flat ids) of all texts."""
        coded = self.codes(texts)
        ends = np.zeros(len(texts) + 1, np.int64)
        if not self.count:
            return ends, np.zeros(0, np.int32)
        count, start, flat = (np.frombuffer(x, t) for x, t in ((self.count, np.int32), (self.start, np.int64), (self.flat, np.int32)))
        np.cumsum([count[c].sum(dtype=np.int64) for c in coded], out=ends[1:])
        each = np.concatenate(coded)
        n = count[each]
        at = np.cumsum(n, dtype=np.int64) - n
        return ends, flat[np.repeat(start[each] - at, n) + np.arange(int(ends[-1]))]

    def decode(self, words: list[str]) -> str:
        index, said = self.index, self.said
        return " ".join([said[index[w]] for w in words])


_tables: dict[tuple[str, bool], ChunkTable] = {}


def chunk_table(model: bytes, decoded: bool = True) -> ChunkTable:
    """This process's table for a model; one at a time."""
    key = hashlib.md5(model).hexdigest(), decoded
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(model, decoded=decoded)
    return _tables[key]


def blocks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about _BLOCK characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BLOCK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def read_model(path: str) -> bytes:
    """The model's bytes, read on the driver and sent with the tasks; a vocabulary file has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded for every row of docs."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in blocks(texts):
                words = [marked_words(t) for t in texts[lo:hi]]
                ends, flat = table.encode(words)
                ids = list_column(ends.astype(np.int32), pa.array(flat, pa.int32()))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), ids, pa.array([table.decode(w) for w in words], pa.string())], ["doc_id", "ids", "decoded"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string", TEXTS)


def count_ids(rows: DataFrame, model_path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """rows with the text column replaced by the number of its ids."""
    model = read_model(model_path)
    at = rows.columns.index(text_col)
    names = [out if c == text_col else c for c in rows.columns]
    schema = ", ".join(f"`{n}` {'long' if n == out else rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model, decoded=False)
        for b in batches:
            texts = b.column(at).to_pylist()
            counts = [table.counts([marked_words(t or "") for t in texts[lo:hi]]) for lo, hi in blocks([t or "" for t in texts])]
            cols = list(b.columns)
            cols[at] = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.record_batch(cols, names)

    return map_arrow(rows, run, schema, TEXTS)


def ids_text(ids):
    """Decimal ids joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))
