"""Sum-of-squares online packing of tokenised documents into fixed windows.

Documents arrive one by one. Whole windows are cut off a long document at once; its rest is
placed into the fill level that keeps the sum of squared counts of partially filled windows
least, which a level array of 2,047 counters decides. Open windows are bounded: beyond
``open_windows`` of them, and at the end of a task, the emptiest are cut to fill the fullest.
The one window left at the end of a task is stored as sequences of powers of two, which need
no padding. Each task packs the documents it reads, so nothing is shuffled.

Rows: a null text counts as empty and holds the closing id alone; ids of documents may be null
or repeat, every row is packed. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import tokenizer_path

WINDOW = 2048
CLOSING_ID = 1
VOCABULARY = "word_bpe_49k.json"
# windows a task keeps open
OPEN_WINDOWS = 512
# bytes of pieces and words, with their ids, that a Python worker remembers, and the longest
# piece it does remember; unspaced text and encoded data come in chunks that never come again
REMEMBERED_BYTES = 192 << 20
LONGEST_REMEMBERED = 64
# what a dictionary entry takes besides its characters and ids
ENTRY_BYTES = 200
CLOSING_MARKS = ".,;:!?"
# kinds of bytes: Latin letters, and the digits and marks that stand apart from letters; an
# apostrophe does not, nor do the characters around the names of special tokens
LETTER, MARK, SPACE = 1, 2, 4
KINDS = np.zeros(256, np.uint8)
KINDS[list(string.ascii_letters.encode())] = LETTER
KINDS[list((string.digits + string.punctuation).encode())] = MARK
KINDS[list(b"'<|>")] = 0
KINDS[list(b" \n")] = SPACE
# texts tokenised together
TOGETHER = 256

Piece = tuple[int, int, bytes]  # document number, first id, ids as little-endian words


class Known(dict):
    """Ids by piece; a piece that is not there gives None and is asked for."""

    def __init__(self, *found: Iterable[tuple[str, bytes]]) -> None:
        super().__init__(*found)
        self.asked: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.asked.append(piece)


class ChunkEncoder:
    """Ids of whole texts as little-endian 32-bit words.

    The vocabulary splits at white space before anything else, and neither its normalisation
    nor its merges look across a space or line feed, nor from a Latin letter to a digit or mark
    beside it. So texts are cut there, every different piece of the texts is looked up once, and
    its ids are remembered. A new piece of Latin letters and closing marks is divided into these
    two, letters lower-cased, as the vocabulary itself does; what is left to do for such a part,
    the merges, the tokeniser's model does alone. Any other piece goes through the whole
    tokeniser.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # words between spaces, through the merges alone
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = Sequence(
            [WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.remembered = remembered
        self.known, self.words, self.held = Known(), {}, 0

    def _forget(self, pieces: list[str]) -> None:
        """Keep what the present texts need, which frequent words are among."""
        known = self.known
        self.known = Known((p, known[p]) for p in pieces if p in known)
        self.words.clear()
        self.held = sum(map(_size, self.known, self.known.values()))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        ends, ids = self.ids(texts)
        words, ends = ids.tobytes(), (4 * ends).tolist()
        return [words[a:b] for a, b in pairwise(ends)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each begin and end; no text may be null."""
        pieces, firsts = _pieces(texts.cast(pa.string()))
        coded = pieces.dictionary_encode()
        found = self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy()
        taken = lengths[which]
        ends = np.concatenate([[0], np.cumsum(taken)])
        shifts = (begins[which] - ends[:-1]).astype(np.int32)
        places = np.arange(ends[-1], dtype=np.int32) + np.repeat(shifts, taken)
        return ends[firsts], np.frombuffer(b"".join(found), "<i4")[places]

    def _found(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        if self.held > self.remembered:
            self._forget(pieces)
        known = self.known
        found = list(map(known.__getitem__, pieces))
        asked = known.asked
        if asked:
            self._learn(asked)
            found = [known[p] if ids is None else ids for p, ids in zip(pieces, found)]
            for piece in asked:
                if len(piece) > LONGEST_REMEMBERED:
                    del known[piece]
                else:
                    self.held += _size(piece, known[piece])
            asked.clear()
        return found

    def _learn(self, pieces: list[str]) -> None:
        known, words = self.known, self.words
        split = {piece: parts for piece in pieces if (parts := _parts(piece))}
        new = list(dict.fromkeys(p for parts in split.values() for p in parts if p not in words))
        ids = dict(zip(new, self._merged(new), strict=True))
        for piece, parts in split.items():
            known[piece] = b"".join([ids.get(part) or words[part] for part in parts])
        for part in new:
            if part not in known and len(part) <= LONGEST_REMEMBERED:
                words[part] = ids[part]
                self.held += _size(part, ids[part])
        others = [piece for piece in pieces if piece not in split]
        for at in range(0, len(others), 10_000):
            part = others[at:at + 10_000]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            for piece, found in zip(part, encoded, strict=True):
                known[piece] = array("I", found.ids).tobytes()

    def _merged(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each part; only the last id of a part is one that ends a word."""
        for at in range(0, len(parts), 1_000):
            joined = " ".join(parts[at:at + 1_000])
            found = self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            words = array("I", found).tobytes()
            ends = (4 * np.flatnonzero(self.last[found]) + 4).tolist()
            yield from (words[a:b] for a, b in pairwise([0, *ends]))


def _pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of all texts, and where those of each begin and end.

    A piece begins with a text, at a space or line feed, and between a Latin letter and a digit
    or mark; the spaces are left out. Chunks too long to be remembered are cut at spaces alone.
    """
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:][:len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    edges = edges - edges[0]
    data = _lowered(data)
    kinds = KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # × and ÷ are no letters
    kinds[lead] = kinds[lead + 1] = LETTER
    begins = np.zeros(len(data) + 1, bool)
    begins[:-1] = spaces = kinds == SPACE
    begins[edges] = True
    chunks = np.flatnonzero(begins)
    begins[1:-1] |= kinds[:-1] + kinds[1:] == LETTER + MARK
    for at in np.flatnonzero(np.diff(chunks) > LONGEST_REMEMBERED):
        begins[chunks[at] + 1:chunks[at + 1]] = False
    starts = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(spaces, dtype=np.int32)], dtype=np.int32)
    pieces = pa.StringArray.from_buffers(
        len(starts) - 1,
        pa.py_buffer((starts - before[starts]).astype(np.int32)),
        pa.py_buffer(data[~spaces]),
    )
    return pieces, np.searchsorted(starts, edges)


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, as the vocabulary makes them.

    A capital before another alphabet's byte stays, which may be composed with it first; all do
    where a special token may stand, as its name would be found in capitals too.
    """
    if ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any():
        return data
    capitals = (data >= ord("A")) & (data <= ord("Z"))
    capitals[:-1] &= data[1:] < 0x80
    return data + np.uint8(32) * capitals


def _parts(piece: str) -> tuple[str, ...] | None:
    """Lower-case Latin letters and the closing marks behind them, if a piece is just that."""
    letters = piece.rstrip(CLOSING_MARKS)
    small = letters.lower()
    if small.isalpha() and (small.isascii() or max(small) < "\u0250"):
        return (small, piece[len(letters):]) if len(letters) < len(piece) else (small,)
    return None


def _size(chunk: str, ids: bytes) -> int:
    return ENTRY_BYTES + len(ids) + (1 if chunk.isascii() else 4) * len(chunk)


ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in ENCODERS:
        ENCODERS[path] = ChunkEncoder(path)
    return ENCODERS[path]


class SumOfSquares:
    """Windows of one task; ``close`` gets the pieces of every finished window."""

    def __init__(self, close: Callable[[list[Piece]], None], window: int = WINDOW,
                 open_windows: int = OPEN_WINDOWS) -> None:
        self.close, self.window, self.open_windows = close, window, open_windows
        self.counts = np.zeros(window, np.int64)
        self.at_level: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.open = 0

    def add(self, doc: int, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self.close([(doc, start, ids[4 * start:4 * (start + self.window)])])
        if whole < total:
            self._place((doc, whole, ids[4 * whole:]))

    def _best_level(self, size: int) -> int:
        """The level whose window should take ``size`` more; 0 opens a window."""
        counts, window = self.counts, self.window
        last = window - size
        # what each choice adds to the sum of squares: one window less at its level, one
        # more at the level it reaches unless that is full
        change = 1 - 2 * counts[1:last + 1]
        change[:last - 1] += 1 + 2 * counts[size + 1:window]
        change[counts[1:last + 1] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        return best + 1 if change[best] <= 1 + 2 * counts[size] else 0

    def _place(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        level = self._best_level(size)
        if level:
            pieces = self.at_level[level].pop()
            self.counts[level] -= 1
            self.open -= 1
            pieces.append(piece)
        else:
            pieces = [piece]
        self._keep(pieces, level + size)
        if self.open > self.open_windows:
            self.merge()

    def _keep(self, pieces: list[Piece], level: int) -> None:
        if level == self.window:
            self.close(pieces)
            return
        self.at_level[level].append(pieces)
        self.counts[level] += 1
        self.open += 1

    def merge(self) -> None:
        """Cut the emptiest windows to fill the fullest; at most one stays partly filled."""
        waiting = deque(
            (level, pieces)
            for level in range(self.window - 1, 0, -1)
            for pieces in self.at_level[level]
        )
        self.at_level = [[] for _ in range(self.window)]
        self.counts[:] = 0
        self.open = 0
        while waiting:
            level, pieces = waiting.popleft()
            while level < self.window and waiting:
                held, others = waiting.pop()
                doc, start, ids = others.pop()
                size = len(ids) // 4
                taken = min(size, self.window - level)
                pieces.append((doc, start, ids[:4 * taken]))
                level += taken
                held -= size
                if taken < size:
                    others.append((doc, start + taken, ids[4 * taken:]))
                    held += size - taken
                if others:
                    waiting.append((held, others))
            self._keep(pieces, level)

    def finish(self) -> None:
        self.merge()
        for level in range(self.window):
            for pieces in self.at_level[level]:
                left = level
                while left:
                    size = 1 << (left.bit_length() - 1)
                    part, pieces = _cut(pieces, size)
                    self.close(part)
                    left -= size


def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    head: list[Piece] = []
    for at, (doc, start, ids) in enumerate(pieces):
        length = len(ids) // 4
        if length > size:
            if size:
                head.append((doc, start, ids[:4 * size]))
            return head, [(doc, start + size, ids[4 * size:]), *pieces[at + 1:]]
        head.append((doc, start, ids))
        size -= length
    return head, []


def _pack(path: str, window: int, closing_id: int, open_windows: int, id_type: pa.DataType,
          with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        closing = int(closing_id).to_bytes(4, "little")
        # documents with a piece in an open window: id and number of tokens
        docs: dict[int, tuple[object, int]] = {}
        waiting: dict[int, int] = {}
        rows: list[tuple] = []

        def close(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids in pieces:
                name, tokens = docs[doc]
                length = len(ids) // 4
                rows.append((name, start, length, zlib.crc32(ids), tokens, sequence, offset,
                             ids if with_ids else None))
                offset += length
                waiting[doc] -= length
                if not waiting[doc]:
                    del waiting[doc], docs[doc]
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            rows.clear()
            arrays = [pa.array(columns[0], id_type)]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                     "offset"]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        packer = SumOfSquares(close, window, open_windows)
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column("content")
                for name, ids in zip(
                    part.column("doc_id").to_pylist(), encoder(path).encode(texts), strict=True
                ):
                    ids += closing
                    docs[number] = (name, len(ids) // 4)
                    waiting[number] = len(ids) // 4
                    packer.add(number, ids)
                    number += 1
                yield out()
        packer.finish()
        yield out()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    closing_id: int = CLOSING_ID,
    open_windows: int = OPEN_WINDOWS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the ids of the piece as little-endian 32-bit words.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = (
        f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, "
        "doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    )
    path = vocabulary or tokenizer_path(VOCABULARY)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content")
    ).mapInArrow(
        _pack(path, window, closing_id, open_windows, to_arrow_type(kind), with_ids), schema
    )
