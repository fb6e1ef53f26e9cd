"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text is cut into pieces (a word with its leading blank, a number, a run of signs or blanks) by a finite automaton that looks
at most three characters ahead, and each piece is merged into tokens. A piece can be as long as the text, so long ones
are merged while they arrive: what follows can change the tokens of a piece only as far back as a chain of merges
reaches, and the longest such chain is computed from the merge list (:attr:`Vocabulary.lookahead`). Tokens further back
are stable and leave; memory stays constant. Decoding is a state machine too, from bytes to characters.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_TEXT = 1 << 10  # characters; longer texts pass through the stream in several parts of that size
LONG_PIECE = 1 << 12  # characters; longer pieces are merged while they arrive
PART_BYTES = 8 << 20  # texts encoded, or ids decoded, before their rows leave
_SENT: set[tuple[str, str]] = set()
KEPT_PIECES = 400_000  # pieces whose tokens a worker remembers

# The characters of the Unicode property White_Space.
BLANKS = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _ranges(codes: Iterable[int]) -> str:
    out, first, last = [], None, None
    for c in [*codes, None]:
        if first is not None and c == last + 1:
            last = c
            continue
        if first is not None:
            out.append(f"\\U{first:08x}-\\U{last:08x}")
        first = last = c
    return "".join(out)


@lru_cache(maxsize=1)
def _automata() -> tuple[re.Pattern, list[re.Pattern]]:
    """The piece pattern, and one pattern per kind of run for what continues a run that has begun."""
    kinds = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in kinds:
            kinds[k].append(c)
    letters, digits, blanks = _ranges(kinds["L"]), _ranges(kinds["N"]), _ranges(BLANKS)
    runs = [f"[{letters}]", f"[{digits}]", f"[^{letters}{digits}{blanks}]"]
    pieces = "'(?:[stmd]|re|ve|ll)|" + "|".join(f" ?{r}+" for r in runs) + f"|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    return re.compile(pieces), [re.compile(f"{r}*") for r in (*runs, f"[{blanks}]")]


class Vocabulary:
    """A byte-level BPE vocabulary from a file of base64 tokens and ranks; ids are ranks, and the merge order."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}

    def merge(self, data: bytes, below: int | None = None) -> list[bytes]:
        """Tokens of ``data``: the pair of lowest rank is merged, leftmost first, until none is left (or none ``below``)."""
        n = len(data)
        if n < 2:
            return [data] if n else []
        ranks, most = self.ranks, below if below is not None else 1 << 60
        start, end, prev = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2], most)) < most]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the pair has been merged meanwhile
            end[i], alive[j] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(data[i : end[stop]], most)) < most:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = prev[i]
            if h >= 0 and (r := ranks.get(data[h:stop], most)) < most:
                heapq.heappush(heap, (r, h, stop))
        return [data[i : end[i]] for i in start if alive[i]]

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return tuple(self.ranks[t] for t in self.merge(data))

    @cached_property
    def lookahead(self) -> int:
        """Bytes after which a token boundary cannot change any more.

        Text added on the right first changes a boundary at the end. A merge (u, v) can carry the change on to the
        boundary between u and v, |v| bytes to the left at most, if v holds the change: because v contains the merge that
        carried it so far, or because v ends in the left part of that merge. Ranks rise along such a chain, so the
        longest one follows from one pass over the merges in order.
        """
        reach: dict[bytes, int] = {}  # by the merge that makes a token
        inside: dict[bytes, int] = {}  # the most over all merges inside a token
        stolen: dict[bytes, int] = {}  # the most over merges so far with this left part
        last: dict[bytes, bytes] = {}  # right part of a token's merge
        for rank, token in sorted(self.bytes_of.items()):
            if len(token) < 2:
                continue
            parts = self.merge(token, below=rank)
            if len(parts) != 2:
                continue  # no merge makes it
            u, v = parts
            most, x = inside.get(v, 0), v
            while True:
                most = max(most, stolen.get(x, 0))
                if x not in last:
                    break
                x = last[x]
            reach[token] = len(v) + most
            inside[token] = max(reach[token], inside.get(u, 0), inside.get(v, 0))
            stolen[u] = max(stolen.get(u, 0), reach[token])
            last[token] = v
        return max(reach.values(), default=0) + 1


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file, loaded once per process."""
    return Vocabulary(path)


class _Pieces(dict):
    """Tokens of pieces met before; forgets all when full."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = self.vocab.encode_piece(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class _PieceStream:
    """Merges one piece while its bytes arrive."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.data = vocab, b""

    def feed(self, data: bytes) -> list[int]:
        self.data += data
        keep = self.vocab.lookahead
        if len(self.data) < 2 * keep + LONG_PIECE:
            return []
        ids, at = [], 0
        for token in self.vocab.merge(self.data):
            if at + len(token) > len(self.data) - keep:
                break
            at += len(token)
            ids.append(self.vocab.ranks[token])
        self.data = self.data[at:]
        return ids

    def finish(self) -> list[int]:
        data, self.data = self.data, b""
        return list(self.vocab.encode_piece(data)) if data else []


class StreamEncoder:
    """Text in parts of any size to ids: :meth:`feed` returns the ids that are stable, :meth:`finish` the rest."""

    def __init__(self, vocab: Vocabulary, pieces: _Pieces | None = None):
        self.vocab, self.text, self.run = vocab, "", None
        self.pieces = _Pieces(vocab) if pieces is None else pieces
        self.stream: _PieceStream | None = None

    def feed(self, text: str) -> list[int]:
        self.text += text
        ids: list[int] = []
        while True:
            if self.stream is not None and not self._go_on(ids, False):
                return ids
            self._whole_pieces(ids)
            if len(self.text) <= LONG_PIECE:
                return ids
            self._begin_long()

    def finish(self) -> list[int]:
        ids: list[int] = []
        if self.stream is not None:
            self._go_on(ids, True)
        ids.extend(chain.from_iterable(map(self.pieces.__getitem__, _automata()[0].findall(self.text))))
        self.text = ""
        return ids

    def _whole_pieces(self, ids: list[int]) -> None:
        """Pieces that nothing to come can change: the next character is known, and three from the start."""
        done, size = 0, len(self.text)
        for m in _automata()[0].finditer(self.text):
            if m.end() >= size or m.start() + 3 > size:
                break
            ids.extend(self.pieces[m.group()])
            done = m.end()
        self.text = self.text[done:]

    def _begin_long(self) -> None:
        """The text kept back is one long piece: from now on its run is merged while it arrives."""
        at = 1 if self.text[0] == " " and not _automata()[1][3].match(self.text[1]).end() else 0
        self.run = next(r for r in _automata()[1] if r.match(self.text[at]).end())
        self.stream = _PieceStream(self.vocab)
        if at:
            ids = self.stream.feed(b" ")
            assert not ids
            self.text = self.text[1:]

    def _go_on(self, ids: list[int], last: bool) -> bool:
        """Takes the run's characters off the text. True where the run has ended."""
        blank = self.run is _automata()[1][3]
        end = self.run.match(self.text).end()
        over = end < len(self.text) or last
        take = end
        if blank and not (last and end == len(self.text)):
            take = max(0, end - 1)  # the last blank belongs to what follows it
        ids.extend(self.stream.feed(self.text[:take].encode()))
        self.text = self.text[take:]
        if over:
            ids.extend(self.stream.finish())
            self.stream = self.run = None
        return over


class StreamDecoder:
    """Ids in parts of any size to text; bytes of an unfinished character wait, broken ones become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.vocab.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Encoder:
    """Whole texts to ids, remembering pieces between texts."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pieces = vocab, _Pieces(vocab)

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in parts of bounded size."""
        stream = StreamEncoder(self.vocab, self.pieces)
        for at in range(0, len(text), LONG_TEXT):
            yield stream.feed(text[at : at + LONG_TEXT])
        yield stream.finish()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text)))


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def _parts(batches: Iterator[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of each batch in parts of at most so many bytes, or one row, in the second column."""
    for b in batches:
        flat = b.column(1)
        size = pc.binary_length(flat) if pa.types.is_string(flat.type) else pc.multiply(pc.list_value_length(flat), 4)
        upto, at = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def _sent(df: DataFrame, path: str) -> str:
    """Sends the vocabulary to the executors, once per application; returns the name of the file there."""
    context = df.sparkSession.sparkContext
    if (context.applicationId, path) not in _SENT:
        context.addFile(path)
        _SENT.add((context.applicationId, path))
    return os.path.basename(path)


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: the token ids of each document's text, without special tokens.

    Null and empty texts have the empty list. Text that spells a special token is ordinary text. One row per row of
    ``documents``.
    """

    name = _sent(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _encoder(SparkFiles.get(name)).parts
        for b in _parts(batches):
            ids, offsets = array("i"), np.zeros(b.num_rows + 1, np.int32)
            for i, text in enumerate(b.column(1).to_pylist()):
                for part in parts(text) if text else ():
                    ids.extend(part)
                offsets[i + 1] = len(ids)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text``: the text of each list of ids; a null list has none."""

    name = _sent(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        for b in _parts(batches):
            texts = []
            for ids in b.column(1).to_pylist():
                state = StreamDecoder(vocab)
                texts.append(None if ids is None else state.feed(ids) + state.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(documents: DataFrame, columns: tuple[str, ...], path: str = VOCABULARY) -> DataFrame:
    """``columns..., n_tokens`` per document: how many ids its text has, 0 for null."""
    chosen = documents.select(*columns, "text")
    kinds = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in columns)

    name = _sent(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(SparkFiles.get(name)).count
        for b in batches:
            n = [count(t) if t else 0 for t in b.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*columns, "n_tokens"])

    return chosen.mapInArrow(run, f"{kinds}, n_tokens bigint")
