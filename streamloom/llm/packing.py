"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


#: Documents and ids that a task packs together at most; a longer document is taken alone.
CHUNK_DOCS, CHUNK_IDS = 4096, 4_000_000
#: Words whose ids a worker keeps, about 150 MB of them; a new word takes ten times as long as a kept one or more.
CACHE_WORDS = 600_000
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer:
    """Ids of a byte-level BPE tokenizer file, with the ids of words kept.

    Texts of plain characters (ASCII and the Latin letters up to U+024F) are
    cut by the tokenizer's own word pattern, here for those characters, and
    each new word goes through the tokenizer's model; a text with any other
    character, or with the content of an added token, goes through the whole
    tokenizer, which gives such content its own id. With a file whose words are
    cut, changed or looked up otherwise, every text does.
    """

    LETTER, SPACE = "A-Za-zÀ-ÖØ-öø-ɏ", "\t-\r "
    WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[0-9]+| ?[^{SPACE}{LETTER}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    #: Words whose ids one tokenizer keeps.
    MOST_WORDS = CACHE_WORDS
    OTHER = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.words = self.whole.model, {}
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.by_words = self._cuts_words(json.loads(self.whole.to_str()))
        # printable bytes stand for themselves, the others for the characters from U+0100 on, in order
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.shown = {b: b if b in shown else next(rest) for b in range(256)}

    @staticmethod
    def _cuts_words(file: dict) -> bool:
        """Whether a tokenizer cuts texts by WORD and knows no more of a word than its bytes."""
        cut, model = file["pre_tokenizer"] or {}, file["model"]
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        whole = not any(file[k] for k in ("normalizer", "truncation", "padding"))
        return whole and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and model["type"] == "BPE" and plain

    def _new(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]
        self.words[word] = out = np.array(ids, "<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.by_words or self.OTHER.search(text) or any(x in text for x in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > self.MOST_WORDS:
            self.words.clear()
        words, new = self.words, self._new
        return b"".join([words.get(w) or new(w) for w in self.WORD.findall(text)])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in item, length, sequence, offset) for items of these lengths.

    Whole capacities of a long item fill sequences of their own. The rests go,
    longest first, to the sequence of lowest cost that has room for them; the
    cost of a piece is linear plus quadratic, n + n * n / capacity. There are as
    few sequences as the ids need, so a rest that fits nowhere is cut along the
    sequences of lowest cost that have any room.
    """
    out, n = [], 0
    for item in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[item]) - capacity + 1, capacity):
            out.append((int(item), start, capacity, n, 0))
            n += 1
    rests = lengths % capacity
    count = -(-int(rests.sum()) // capacity)
    room, cost = np.full(count, capacity), np.zeros(count)
    for item in np.argsort(-rests, kind="stable"):
        left = int(rests[item])
        start = int(lengths[item]) - left
        while left:
            fits = room >= left
            at = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            piece = min(left, int(room[at]))
            out.append((int(item), start, piece, n + at, capacity - int(room[at])))
            room[at] -= piece
            cost[at] += piece + piece * piece / capacity
            left, start = left - piece, start + piece
    return out


def _packed_batches(path: str, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used = tokenizer(path), TaskContext.get().partitionId() << 40
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0
        end = np.array([END_ID], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, size, used
            lengths = np.array([len(x) // 4 for x in held])
            rows = sorted(assign(lengths, capacity))
            parts = [held[i][4 * s : 4 * (s + n)] for i, s, n, _, _ in rows]
            item, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            cols = [
                pa.array([docs[i] for i in item], pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array(lengths[item]),
                pa.array(sequence + used),
                pa.array(offset),
            ]
            names = [f.split()[0] for f in PIECES.split(", ")]
            if with_ids:
                cols.append(pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            used += int(sequence.max()) + 1
            docs, held, size = [], [], 0
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                held.append(own.ids(text.as_py() or "") + end)
                size += len(held[-1]) // 4
                if len(held) >= CHUNK_DOCS or size >= CHUNK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of PIECES: where each id of each document lies; with_ids adds the ids.

    A document's ids are those of its text by the tokenizer, then id 1. Each
    task packs runs of up to CHUNK_DOCS documents, so nothing is shuffled and
    less than one sequence a run is padding. Sequence ids hold the task's number.

    A null or empty text is id 1 alone; a very long one fills sequences of its
    own and its rest goes with the others. Ids may be null or repeat: each row
    is a document of its own. Of equally long rests the earlier goes first, of
    sequences of equal cost the first is taken. An empty table gives no rows;
    other columns are not read.
    """
    docs = documents.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    run = _packed_batches(tokenizer_path or default_tokenizer(), capacity, with_ids)
    return docs.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
