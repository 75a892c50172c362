"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised by the model's own rules, which write blanks as ``▁``, and cut into segments:
runs of ``▁`` with the characters after them. No piece of such a vocabulary has a ``▁`` behind
another character (a model with one is refused), so no merge crosses a cut and each segment can
be encoded alone, once for all its occurrences in a batch.

A segment starts as its single characters. An agenda holds the adjacent pairs of symbols that form
a piece, the best score first, then the leftmost. The first pair is merged and its neighbours'
new pairs enter. The agenda of a long segment is a heap, in which pairs whose symbols have changed
are skipped; those of short ones are the rows of an array, so that a batch's segments of one
length go through their agendas together. What is no piece in the end is written as bytes, or as
the unknown id if the model has no byte pieces.

A task keeps the ids of its segments; the new ones of each Arrow batch are compared with the
sentencepiece library; ``differences`` compares whole texts. Decoding is the library's.

Memory: a task holds a slice of 2 MB of text (a longer text is a slice of its own).

Edge cases: null and empty texts have the begin and end ids only; texts of blanks, of characters
the vocabulary lacks, with ``▁`` or with the spelling of control pieces are ordinary text;
repeated rows and null keys give a row each; an empty table gives no rows; further columns, also
of the results' names, are left out of the result, which has the key and its own columns.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import as_strings, slices

BLANK = "▁"
NONE = np.iinfo(np.int32).max
"""Rank of a pair that makes no piece."""
DEAD = np.iinfo(np.int32).min
"""Symbol that was merged into the one before it."""
LONGEST_ROW = 64
"""Characters of a segment that is merged together with others of its length."""
MOST_CHARS = 0x110000
MOST_KNOWN = 1 << 19
"""Segments whose ids a task keeps for its next batches; a batch of more keeps its own."""
MODEL_BYTES = 64 << 20
"""Largest model file: it travels to every executor."""


@dataclass
class Vocabulary:
    """What merging needs of a model. Symbols are numbers: ids of pieces, then other characters."""

    library: sentencepiece.SentencePieceProcessor
    symbols: dict[str, int]  # pieces and the characters in them
    pairs: dict[tuple[int, int], tuple[int, int]]  # adjacent symbols: rank of their piece, piece
    byte_ids: list[int]  # of the 256 byte pieces, or empty
    unknown: int
    ends: tuple[list[int], list[int]]  # begin and end ids

    @staticmethod
    def of(model: bytes) -> Vocabulary:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        symbols, scores, byte_ids = {}, {}, []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                byte_ids.append((int(piece[3:5], 16), i))
            elif library.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif not library.is_control(i) and not library.is_unknown(i):
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"piece {i} has a blank behind another character")
                symbols[piece], scores[piece] = i, library.get_score(i)
        for piece in list(symbols):
            for c in piece:
                symbols.setdefault(c, library.get_piece_size() + len(symbols))
        rank = {score: r for r, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank[score], symbols[piece])
        begin, end = library.bos_id(), library.eos_id()
        ends = ([begin] if begin >= 0 else [], [end] if end >= 0 else [])
        return Vocabulary(library, symbols, pairs, [i for _, i in sorted(byte_ids)], library.unk_id(), ends)


def merge(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """The symbols of one segment, each at its first character, by a heap of adjacent pairs."""
    symbols, pairs = list(symbols), vocabulary.pairs
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int]] = []

    def propose(left: int, right: int) -> None:
        if left >= 0 and right < n:
            known = pairs.get((symbols[left], symbols[right]))
            if known is not None:
                heapq.heappush(agenda, (known[0], left, right, known[1]))

    for left in range(n - 1):
        propose(left, left + 1)
    while agenda:
        _, left, right, piece = heapq.heappop(agenda)
        # the symbols may have grown since, or be gone
        if after[left] != right or pairs.get((symbols[left], symbols[right]), (0, -1))[1] != piece:
            continue
        symbols[left], symbols[right] = piece, DEAD
        after[left], after[right] = after[right], -1
        if after[left] < n:
            before[after[left]] = left
        propose(before[left], left)
        propose(left, after[left])
    return symbols


class PairTable:
    """The pairs as sorted arrays, to look many up at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 32) + b for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(values[order, 0], NONE).astype(np.int32)
        self.piece = np.append(values[order, 1], DEAD).astype(np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair; ``NONE`` where the pair makes no piece."""
        wanted = (left.astype(np.int64) << 32) + right
        at = np.searchsorted(self.keys, wanted)
        hit = self.keys[at] == wanted
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.piece[at], DEAD)


def merge_rows(grid: np.ndarray, table: PairTable) -> np.ndarray:
    """``merge`` of many segments of one length, a row each.

    A row's agenda is the ranks of its adjacent pairs, each at its left symbol; a round takes
    every row's first by (rank, place) and looks up the two pairs that change.
    """
    rows, width = grid.shape
    # a column at either end that fits nothing, so that a row's ends need no case of their own
    symbols = np.full((rows, width + 2), DEAD, np.int32)
    symbols[:, 1:-1] = grid
    after = np.broadcast_to(np.arange(1, width + 3, dtype=np.int16), symbols.shape).copy()
    before = np.broadcast_to(np.arange(-1, width + 1, dtype=np.int16), symbols.shape).copy()
    rank, piece = np.full(symbols.shape, NONE, np.int32), np.full(symbols.shape, DEAD, np.int32)
    rank[:, 1:-2], piece[:, 1:-2] = table.find(symbols[:, 1:-2], symbols[:, 2:-1])
    line = np.arange(rows)
    while len(line):
        own = rank if len(line) == rows else rank[line]
        best = own.argmin(axis=1)
        go = own[np.arange(len(line)), best] != NONE
        line, best = line[go], best[go]
        right = after[line, best]
        symbols[line, best] = piece[line, best]
        symbols[line, right], rank[line, right] = DEAD, NONE
        beyond, ahead = after[line, right], before[line, best]
        after[line, best], before[line, beyond] = beyond, best
        made = symbols[line, best]
        rank[line, best], piece[line, best] = table.find(made, symbols[line, beyond])
        rank[line, ahead], piece[line, ahead] = table.find(symbols[line, ahead], made)
    return symbols[:, 1:-1]


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, model: bytes, checked: bool = True):
        self.vocabulary, self.checked = Vocabulary.of(model), checked
        self.table = PairTable(self.vocabulary.pairs)
        self._forget()
        self.whole = not self.vocabulary.byte_ids  # unknown ids join across segments
        symbols = {ord(s): i for s, i in self.vocabulary.symbols.items() if len(s) == 1}
        self.of_char = np.full(MOST_CHARS, -1, np.int32)  # of a character; others stay below 0
        self.of_char[list(symbols)] = list(symbols.values())
        self.pieces = self.vocabulary.library.get_piece_size()

    def _segments(self, texts: pa.StringArray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(segment of each place in order, segments, bounds of the texts)."""
        library = self.vocabulary.library
        normal = pa.array([library.normalize(t) for t in texts.to_pylist()], pa.large_string())
        if self.whole:
            return np.arange(len(texts)), normal.to_pylist(), np.arange(len(texts) + 1)
        lists = pc.split_pattern(normal, BLANK)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.dictionary_encode()
        codes, parts = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()
        empty = np.asarray(pc.equal(coded.dictionary, ""))[codes] if len(parts) else np.zeros(0, bool)
        place = np.arange(len(codes))
        first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        # blanks of a part: its own and those of the empty parts right before it
        stop = np.maximum.accumulate(np.where(first | ~empty, place, -1)) if len(codes) else place
        stop = np.concatenate([[-1], stop[:-1]])
        blanks = np.where(first, 0, place - stop)
        kept = ~empty | (last & ~first)
        codes, blanks = codes[kept], blanks[kept]
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        segments, which = [BLANK + p for p in parts], codes
        odd = np.flatnonzero(blanks != 1)
        if len(odd):
            pairs, place = np.unique(np.stack([blanks[odd], codes[odd]]), axis=1, return_inverse=True)
            which = which.copy()
            which[odd] = len(segments) + place.ravel()
            segments = segments + [BLANK * int(b) + parts[c] for b, c in pairs.T]
        return which, segments, bounds

    def _merged(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments one after another, their bounds)."""
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # a character of no piece is kept as a number below 0 that tells which it is
        symbols = self.of_char[points].astype(np.int64)
        symbols = np.where(symbols >= 0, symbols, -2 - points).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            if size > LONGEST_ROW:
                for i in some:
                    one = slice(starts[i], starts[i + 1])
                    symbols[one] = merge(symbols[one].tolist(), self.vocabulary)
            elif size > 1:
                at = starts[some][:, None] + np.arange(size)
                symbols[at] = merge_rows(symbols[at], self.table)
        kept = symbols != DEAD
        symbols, bounds = symbols[kept], np.concatenate([[0], np.cumsum(kept)])[starts]
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.pieces))
        if not len(odd):
            return symbols, bounds
        names = {i: s for s, i in self.vocabulary.symbols.items() if i >= self.pieces}
        chars = [names[i] if i >= 0 else chr(-2 - i) for i in symbols[odd].tolist()]
        if self.vocabulary.byte_ids:
            new = [[self.vocabulary.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] for c in chars]
            # the last byte stands in the character's place, the others before it
            extra = np.array([len(x) - 1 for x in new])
            symbols[odd] = [x[-1] for x in new]
            symbols = np.insert(symbols, np.repeat(odd, extra), [i for x in new for i in x[:-1]])
        else:
            owner = np.repeat(np.arange(len(segments)), np.diff(bounds))
            symbols[odd] = self.vocabulary.unknown
            joined = odd[1:][(np.diff(odd) == 1) & (owner[odd[1:]] == owner[odd[:-1]])]
            symbols, extra, odd = np.delete(symbols, joined), np.full(len(joined), -1), joined
        grown = np.zeros(bounds[-1] + 1, np.int64)
        grown[odd + 1] = extra
        return symbols, bounds + np.cumsum(grown)[bounds]

    def _compare(self, segments: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        """The library must give the same ids; raises else."""
        library = self.vocabulary.library
        # the library puts a blank before a text, which stands for the segment's first one
        asked = [s[1:].replace(BLANK, " ") for s in segments]
        theirs = library.encode(asked, num_threads=1)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        if np.array_equal(sizes, np.diff(bounds)):
            if np.array_equal(ids, np.fromiter(chain.from_iterable(theirs), np.int32, sizes.sum())):
                return
        for i, other in enumerate(theirs):
            ours = ids[bounds[i] : bounds[i + 1]].tolist()
            if ours != other and library.normalize(asked[i]) == segments[i]:
                raise ValueError(f"{segments[i][:100]!r}: {ours[:50]} is not the library's {other[:50]}")

    def _ids_of(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all known segments, their bounds, the place of each of ``segments``)."""
        if len(self.number) + len(segments) > MOST_KNOWN:
            self._forget()
        new = [s for s in segments if s not in self.number]
        if new:
            flat, bounds = self._merged(new)
            if self.checked and not self.whole:
                self._compare(new, flat, bounds)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
            self.ids = np.concatenate([self.ids, flat])
        return self.ids, self.bounds, np.array([self.number[s] for s in segments], dtype=np.int64)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of the texts), begin and end ids included."""
        which, segments, bounds = self._segments(texts)
        flat, starts, number = self._ids_of(segments)
        which = number[which]
        counts = starts[which + 1] - starts[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(starts[which] - ends[:-1], counts) + np.arange(ends[-1])]
        begin, end = self.vocabulary.ends
        inner, rows = ends[bounds], np.arange(len(texts))
        # begin and end ids of text i are the 2i-th and 2i+1-st to go in, in this order at equal places
        order = np.argsort(np.concatenate([np.repeat(2 * rows, len(begin)), np.repeat(2 * rows + 1, len(end))]), kind="stable")
        at = np.concatenate([np.repeat(inner[:-1], len(begin)), np.repeat(inner[1:], len(end))])
        extra = np.concatenate([np.tile(begin, len(rows)), np.tile(end, len(rows))]).astype(np.int32)
        return np.insert(ids, at[order], extra[order]), inner + (len(begin) + len(end)) * np.arange(len(inner))


def read_model(path: str) -> bytes:
    """The model's bytes, read by the driver and sent to the tasks with the function."""
    if Path(path).stat().st_size > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return Path(path).read_bytes()


def _slim(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return slim, slim.schema["_key"].dataType.simpleString()


def encode_ids(docs: DataFrame, key: str, text: str, model_path: str, checked: bool = True) -> DataFrame:
    """(key, ids array<int>) of each row's whole text."""
    slim, kind = _slim(docs, key, text)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, checked)
        for batch in slices(batches, "_text"):
            ids, bounds = encoder.encode(as_strings(batch.column("_text")))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), lists], [key, "ids"])

    return slim.mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_ids(rows: DataFrame, key: str, ids: str, model_path: str) -> DataFrame:
    """(key, text) of each row's ids, decoded by the library."""
    slim = rows.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    kind = slim.schema["_key"].dataType.simpleString()
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = [library.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(texts, pa.string())], [key, "text"])

    return slim.mapInArrow(run, f"{key} {kind}, text string")


def encoding_digests(docs: DataFrame, key: str, text: str, model_path: str, checked: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded, in one pass.

    Ids are hashed as little-endian unsigned 32-bit integers, the decoded text in UTF-8.
    """
    slim, kind = _slim(docs, key, text)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, checked)
        library = encoder.vocabulary.library
        for batch in slices(batches, "_text"):
            ids, bounds = encoder.encode(as_strings(batch.column("_text")))
            rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            coded = [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
            texts = library.decode([r.tolist() for r in rows], num_threads=1)
            decoded = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(np.diff(bounds), pa.int64()), pa.array(coded), pa.array(decoded)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return slim.mapInArrow(run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def differences(docs: DataFrame, key: str, text: str, model_path: str) -> DataFrame:
    """(key, ids, library_ids) of the rows whose whole text the library encodes to other ids."""
    slim, kind = _slim(docs, key, text)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, checked=False)
        library = encoder.vocabulary.library
        for batch in slices(batches, "_text"):
            texts = as_strings(batch.column("_text"))
            ids, bounds = encoder.encode(texts)
            ours = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            theirs = library.encode(texts.to_pylist(), add_bos=True, add_eos=True, num_threads=1)
            other = [i for i, (a, b) in enumerate(zip(ours, theirs)) if a != b]
            listed = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array(other, pa.int64())),
                    pa.array([ours[i] for i in other], listed),
                    pa.array([theirs[i] for i in other], listed),
                ],
                [key, "ids", "library_ids"],
            )

    return slim.mapInArrow(run, f"{key} {kind}, ids array<int>, library_ids array<int>")
