"""Alignment of two tokenizers' tokens, merged along diagonals."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.packing import WordTokenizer
from streamloom.storage import Workspace

#: Elements that a piece of the merge holds.
PIECE = 1 << 14
#: Words whose ids a worker keeps of each tokenizer.
CACHE_WORDS = 150_000
#: Documents and tokens that a task aligns together at most; a longer document is taken alone.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 3_000_000
SPACE = "▁"

STATS = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
COUNTED = "n_best long, count_sum long, groups_sha256 string"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens(WordTokenizer):
    """Tokens of a byte-level tokenizer file, strings of special tokens being plain text."""

    MOST_WORDS = CACHE_WORDS

    def __init__(self, path: str):
        super().__init__(path)
        self.whole.encode_special_tokens = True
        self.added = []
        byte_of = {chr(shown): byte for byte, shown in self.shown.items()}
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.bytes = np.full(max(vocab.values()) + 1, b"", object)
        for token, k in vocab.items():
            self.bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def of(self, text: str) -> bytes:
        return self.ids(" " + text)


class PieceTokens:
    """Tokens of a sentencepiece file, the ids of words being kept.

    A word is a run of spaces and what follows it. Where no piece goes on past
    a space but runs of spaces and texts are taken as they are, no merge crosses
    words, so each is encoded by itself; with another file whole texts are.
    """

    WORD = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.bytes = np.empty(len(pieces), object)
        for k, piece in enumerate(pieces):
            self.bytes[k] = bytes([int(piece[3:-1], 16)]) if self.model.is_byte(k) else piece.replace(SPACE, " ").encode()
        with open(path, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, kind = spec.normalizer_spec, spec.trainer_spec
        as_is = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        merges = kind.model_type == kind.BPE and not kind.treat_whitespace_as_suffix
        self.by_words = as_is and merges and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.words: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        # the model adds the first space itself
        self.words[word] = out = np.array(self.model.encode(word[1:]), "<u4").tobytes()
        return out

    def of(self, text: str) -> bytes:
        # a single space at the end is a word that the model would not see by itself
        if not self.by_words or text.endswith(" ") or SPACE in text:
            return np.array(self.model.encode(text), "<u4").tobytes()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words, new = self.words, self._new
        return b"".join([words.get(w) or new(w) for w in self.WORD.findall(" " + text)])


_tokens: dict[tuple[str, str], tuple] = {}


def tokenizers(paths: tuple[str, str]) -> tuple[ByteTokens, PieceTokens]:
    """One pair of tokenizers for each worker process."""
    if paths not in _tokens:
        _tokens[paths] = ByteTokens(paths[0]), PieceTokens(paths[1])
    return _tokens[paths]


def diagonals(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b come before each step-th element of their merge, a first where equal.

    Each diagonal of the merge is searched by itself: the split of d elements
    has i of a where i is the least with a[i] > b[d - 1 - i].
    """
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        # an open diagonal has mid < len(a) and d - 1 - mid within b
        take = np.zeros(len(d), bool)
        take[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & take, mid + 1, low), np.where(open_ & ~take, mid, high)
    return low, d - low


def merged(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, cut_a, cut_b) of tokens that end at offsets a and b of the same bytes.

    Links are the pairs of tokens whose bytes overlap, in order; cuts the pairs
    that end together. Pieces of step ends are merged each by itself: what lies
    between two ends is one overlap. A cut whose two ends fall into two pieces
    is found where they are stitched.
    """
    firsts, seconds = diagonals(a, b, step)
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    for k in range(len(firsts) - 1):
        i, i_end, j, j_end = firsts[k], firsts[k + 1], seconds[k], seconds[k + 1]
        ends = np.concatenate([a[i:i_end], b[j:j_end]])
        order = np.argsort(ends, kind="stable")
        ends, of_a = ends[order], order < i_end - i
        # of each end, how many of a and of b come before it
        before_a = i + np.cumsum(of_a) - of_a
        before_b = j + np.cumsum(~of_a) - ~of_a
        last = max(a[i - 1] if i else 0, b[j - 1] if j else 0)
        starts = np.concatenate([[last], ends[:-1]])
        some = ends > starts
        links_a.append(before_a[some])
        links_b.append(before_b[some])
        # an end of b that meets one of a just before it, in this piece or the last
        prior = np.concatenate([[i > 0 and a[i - 1] == last], of_a[:-1]])
        both = ~of_a & prior & ~some
        cuts_a.append(before_a[both] - 1)
        cuts_b.append(before_b[both])
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


def _labels(tokens: int, last: str) -> list[str]:
    """Each id followed by a comma, by last, and by nothing."""
    return [f"{k}{end}" for k in range(tokens) for end in (",", last, "")]


class Aligner:
    """Tokens, links and groups of a block of texts."""

    def __init__(self, paths: tuple[str, str]):
        self.a, self.b = tokenizers(paths)
        sizes = lambda t: np.array([len(x) for x in t.bytes], np.int64)
        self.size_a, self.size_b = sizes(self.a), sizes(self.b)
        self.labels = np.array(_labels(len(self.a.bytes), "|") + _labels(len(self.b.bytes), ";"), object)

    def tokens(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids of both; none where a text is null or empty or its tokens' bytes are not the text's."""
        if not text:
            return b"", b""
        out, whole = (self.a.of(text), self.b.of(text)), b" " + text.encode()
        for ids, own in zip(out, (self.a, self.b), strict=True):
            if b"".join(own.bytes[np.frombuffer(ids, "<u4")]) != whole:
                return b"", b""
        return out

    def align(self, held: list[tuple[bytes, bytes]]) -> tuple[dict[str, np.ndarray], np.ndarray, list[str]]:
        """Counts of each document, the pair of ids of each link in order, and the digest of each document's groups."""
        a, b = (np.frombuffer(b"".join(x[k] for x in held), "<u4").astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) // 4 for x in held], np.int64) for k in (0, 1))
        bound_a, bound_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        link_a, link_b, cut_a, cut_b = merged(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        doc_of = lambda at: np.searchsorted(bound_a, at, "right") - 1
        stats = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of(cut_a), minlength=len(held)), "n_links": np.bincount(doc_of(link_a), minlength=len(held))}

        # tokens in the order of their groups, those of A first
        in_a, in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        code_a, code_b = 3 * a, 3 * len(self.a.bytes) + 3 * b
        code_a[cut_a] += 1
        code_b[cut_b] += 1
        code_b[bound_b[1:][n_b > 0] - 1] += 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(cut_b + 1 - in_b, in_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(cut_a + 1, in_b)] = code_b
        named, at = self.labels[codes], bound_a + bound_b
        digests = [hashlib.sha256("".join(named[at[k] : at[k + 1]]).encode()).hexdigest() if n_a[k] else "" for k in range(len(held))]
        return stats, a[link_a] << 32 | b[link_b], digests


_aligners: dict[tuple[str, str], Aligner] = {}
_BLOCKS = f"block long, pairs array<long>, counts array<long>, docs array<struct<{STATS.replace(' long', ':long')}, groups_sha256:string>>, links binary"


def _packed(ranks: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes, compressed."""
    planes = np.ascontiguousarray(ranks.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8) if count else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, count).T).view("<u4").ravel().astype(np.int64)


def _aligned_batches(paths: tuple[str, str]) -> Callable:
    """Documents to one row a block: its id pairs with their counts, and its documents, whose links are places in the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _aligners:
            _aligners[paths] = Aligner(paths)
        own, block = _aligners[paths], TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, size, block
            stats, codes, digests = own.align(held)
            pairs, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
            # frequent pairs get low places, which take few bytes
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in stats.values()), pa.array(digests, pa.string())], ["doc_id", *stats, "groups_sha256"])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            cols = [pa.array([block], pa.int64()), one(pa.array(pairs[order], pa.int64())), one(pa.array(counts[order], pa.int64())), one(docs), pa.array([_packed(place[inverse])], pa.binary())]
            ids, held, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(cols, ["block", "pairs", "counts", "docs", "links"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                held.append(own.tokens(text.as_py()))
                size += (len(held[-1][0]) + len(held[-1][1])) // 4
                if len(held) >= BLOCK_DOCS or size >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return run


def _summed(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of a block's documents, their links looked up in the corpus-wide counts of the block's pairs."""
    total, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts["pos"].to_numpy()
    total[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
    # a block is one row
    docs = block["docs"].combine_chunks().flatten()
    columns = {name: docs.field(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    per_doc = columns["n_links"].to_numpy()
    links = _unpacked(block["links"][0].as_py(), int(per_doc.sum()))
    ends = np.cumsum(per_doc)
    sums = lambda values: np.diff(np.append(0, np.cumsum(values[links]))[np.append(0, ends)])
    columns |= {"n_best": pa.array(sums(best), pa.int64()), "count_sum": pa.array(sums(total), pa.int64())}
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in f"{STATS}, {COUNTED}".split(", ")})


def align_tokens(documents: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of STATS and COUNTED: how the tokens of two tokenizers lie over each document's bytes.

    The ends of both sides' tokens, over a block of documents, are merged in
    pieces of equal work, which diagonals of the merge part by binary searches;
    a piece gives the overlaps between its ends and the ends that both share,
    and the ends that meet across pieces are stitched into groups. Texts are
    read once. A block leaves the distinct id pairs of its links with their
    counts and, for each document, places in that list; corpus-wide counts are
    sums over blocks, and go back to the blocks whose pairs they are.

    Null and empty texts, and texts whose tokens do not give back a space and
    the text, have no tokens: zeros and an empty digest. A very long text is a
    block by itself. Ids may be null or repeat: each row is a document of its
    own, equal texts have equal results. Of pairs of equal count all are best.
    An empty table gives no rows; other columns are not read.
    """
    docs = documents.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    ws = Workspace(documents.sparkSession, "alignment")
    blocks = ws.table(docs.mapInArrow(_aligned_batches(tuple(paths or default_tokenizers())), _BLOCKS), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "_")).select("block", "pos", "_.pairs", "_.counts")
    counts = ws.table(pairs.groupBy("pairs").agg(F.sum("counts").alias("total")), "counts")
    # one row an id of B: as many as its vocabulary has
    side = F.col("pairs").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    highest = F.broadcast(counts.groupBy(side).agg(F.max("total").alias("most")))
    marked = counts.withColumn("b", side).join(highest, "b").select("pairs", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    known = pairs.drop("counts").join(marked, "pairs").select(F.col("block").alias("of"), "pos", "total", "best")
    summed = blocks.select("block", "docs", "links").groupBy("block").cogroup(known.groupBy("of"))
    return summed.applyInArrow(_summed, f"{STATS}, {COUNTED}")
