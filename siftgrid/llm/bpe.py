"""Byte-level BPE by backtracking over longest matches (operator 6).

Text is cut by the tokenizer's pattern; each distinct piece is encoded once per
worker.  A piece is mapped byte by byte to Latin-1 so that a pyahocorasick
automaton can report, for every position, the longest vocabulary entry that
starts there.  The encoder walks forward with those entries, falls back to the
next shorter prefix when two neighbours could not stand side by side after
merging, and backs up one token when no prefix is left.  Neighbour checks are
memoised, every position is given up at most once, so the time is linear in
the piece.  The result equals merging by rank.

What a worker remembers is bounded by bytes: two generations of pieces and of
neighbour checks are kept, the older one goes when the younger is full, and
what is used again moves to the younger one.

Defined results: a null text is an empty text (no tokens, empty decoding);
repeated rows give repeated results; an empty table gives an empty table; a
very long text or piece is encoded whole, in memory linear in its bytes, and is
not remembered; further columns of ``docs``, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, lean

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of remembered pieces per generation (about ``PIECE_OVERHEAD`` besides text and ids), and the longest piece.
REMEMBERED_BYTES, PIECE_OVERHEAD, MAX_REMEMBERED_BYTES = 24 << 20, 190, 64
#: Neighbour checks that a worker remembers per generation.
REMEMBERED_PAIRS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PieceEncoder:
    """Encodes single pieces; built from ranks, cheap to send to executors."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        usable = ahocorasick.Automaton()
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            if len(token) > 1:
                split = self._last_merge(token, rank)
                if split is None:
                    continue
                self.parts[rank] = split
                self.whole[split] = rank
            else:
                self.parts[rank] = (rank, rank)
            usable.add_word(token.decode("latin-1"), rank)
        usable.make_automaton()
        self.automaton = usable
        for rank in self.parts:
            token = self.bytes_of[rank]
            for n in range(len(token) - 1, 0, -1):
                other = ranks.get(token[:n])
                if other in self.parts:
                    self.shorter[rank] = other
                    break
        #: Answers by ``left << 32 | right``, and those of the generation before.
        self.pairs: dict[int, bool] = {}
        self.older: dict[int, bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two entries that merging joins last to form this one."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts[0] not in self.ranks or parts[1] not in self.ranks:
            return None
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether merging would leave these two side by side.

        Undo the latest merge on either side again and again; the pair is
        broken if at some step the inner neighbours would have joined before
        the merge that is being undone.
        """
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is not None:
            return known
        known = self.older.get(pair)
        if known is None:
            known = self._check(left, right)
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.older, self.pairs = self.pairs, {}
        self.pairs[pair] = known
        return known

    def _check(self, left: int, right: int) -> bool:
        a, b = left, right
        limit = len(self.bytes_of) + (1 << 30)
        while True:
            joined = self.whole.get((a, b))
            if joined is not None and joined < limit:
                return False
            a_inner, b_inner = self.parts[a][1], self.parts[b][0]
            if a > b:
                if a_inner != a:
                    limit, a = a, a_inner
                elif b_inner != b:
                    limit, b = b + 1, b_inner
                else:
                    return True
            elif b_inner != b:
                limit, b = b + 1, b_inner
            elif a_inner != a:
                limit, a = a, a_inner
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [-1] * (n + 1)
        reach = [0] * (n + 1)
        bytes_of = self.bytes_of
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            size = len(bytes_of[rank])
            start = end + 1 - size
            if size > reach[start]:
                reach[start], longest[start] = size, rank
        open_at = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, nxt = 0, longest[0]
        while at < n:
            token = nxt
            while True:
                end = at + len(bytes_of[token])
                if open_at[end] and (not tokens or self._stays_apart(tokens[-1], token)):
                    tokens.append(token)
                    at, nxt = end, longest[end]
                    break
                token = self.shorter.get(token, -1)
                if token < 0:
                    open_at[at] = 0
                    nxt = tokens.pop()
                    at -= len(bytes_of[nxt])
                    break
        return tokens


class TextEncoder(dict):
    """Piece text -> packed little-endian ids, remembered per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.pieces = PieceEncoder(ranks)
        self.cut = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.bytes_of = [self.pieces.bytes_of.get(i, b"") for i in range(size)]
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            raw = piece.encode("utf-8")
            packed = np.array(self.pieces.encode(raw), dtype="<u4").tobytes()
            if len(raw) > MAX_REMEMBERED_BYTES:
                return packed
        self.held += PIECE_OVERHEAD + len(piece) + len(packed)
        if self.held > REMEMBERED_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_WORKER: dict[tuple[str, str], TextEncoder] = {}


def worker_encoder(name: str, ranks: dict[bytes, int], pattern: str) -> TextEncoder:
    if (name, pattern) not in _WORKER:
        _WORKER.clear()
        _WORKER[(name, pattern)] = TextEncoder(ranks, pattern)
    return _WORKER[(name, pattern)]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, digests: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs``.

    What ``digests`` names (``ids``, ``decoded``) is given by its SHA-256 instead
    (``ids_sha256``, ``decoded_sha256``), taken from the same values in the
    worker, so that the text does not travel back only to be hashed.  The
    vocabulary (about 1 MB, fixed) is read once by the driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    name = vocabulary
    short_ids, short_text = "ids" in digests, "decoded" in digests
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()) if short_ids else ("ids", pa.list_(pa.int32())), ("decoded_sha256" if short_text else "decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name, ranks.value, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                packed = encoder.packed(text.as_py() or "")
                decoded = encoder.decode(packed)
                counts.append(len(packed) >> 2)
                first.append(hashlib.sha256(packed).hexdigest() if short_ids else np.frombuffer(packed, dtype="<u4").astype(np.int32))
                second.append(hashlib.sha256(decoded).hexdigest() if short_text else decoded.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((counts, first, second), list(schema)[1:]))], schema=schema)

    kinds = ["doc_id long", "n_tokens long", "ids_sha256 string" if short_ids else "ids array<int>", f"{schema.names[3]} string"]
    return id_and_text(docs).mapInArrow(lean(run), ", ".join(kinds))
