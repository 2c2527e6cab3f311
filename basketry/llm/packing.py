"""Packing tokenized documents into windows by Karmarkar-Karp multiway differencing.

Each partition is read once, in order.  A document's tokens fill whole windows first; what
is left over is cut into pieces of at most ``PIECE`` tokens and collected until a batch of
``WINDOWS`` windows is almost full, the last of them into fine pieces.  The batch is then split into that many near-equal
windows: every piece starts as a partial partition (itself and empty windows), and the two
partial partitions with the largest imbalance are merged with opposing order until one is
left.  If a window is over the capacity, the window count rises by one and the batch is
split again.  Nothing is shuffled, and a task holds one batch, however large the table.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
PIECE = 256
WINDOWS = 48
SLACK = 2  # free tokens a window may have when a batch is closed
# The last tokens of a batch are cut into pieces of these sizes in turn: small differences to
# even out what the large pieces leave.
FINE = (1, 2, 3, 5, 8, 13, 21)
FINE_TOKENS = 1024
CACHED_WORDS = 400_000


class Encoder:
    """Token ids of byte-level BPE, as bytes of little-endian unsigned 32-bit ids.

    No token of this vocabulary's splitting pattern reaches over the start of a run of white
    space, so a text cut there is encoded word by word, and the words are kept (a bounded
    number).  Texts with two neighbouring spaces or line ends are encoded whole.  ``path`` is
    the tokenizer's JSON file; if the same vocabulary lies beside it as ranks, new words are
    merged from these, which gives the same ids in a quarter of the time.
    """

    _between = re.compile(r"\s[ \n]|^[ \n]")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are plain text
        self.known: dict[str, bytes] = {}
        self.ranks = self._ranks(path.removesuffix(".json") + ".tiktoken")

    @staticmethod
    def _ranks(path: str):
        import base64
        import os

        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(no) for word, no in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def words(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self.whole(texts)
        return [np.asarray(self.ranks.encode_ordinary(t), "<u4").tobytes() for t in texts]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._between.search(text):
            return self.whole([text])[0]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]  # the first word has no space before it
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            new = [p for p in set(parts) if p not in known]
            full = [p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in new]
            known.update(zip(new, self.words(full)))
            return b"".join(map(known.__getitem__, parts))


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``windows`` groups of near-equal sums."""
    heap: list = []
    for no, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, no, sums, [[no]] + [None] * (windows - 1)))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, s, g = heapq.heappop(heap)
        _, _, t, h = heapq.heappop(heap)
        sums = s + t[::-1]  # sums are kept in falling order: the fullest meets the emptiest
        order = np.argsort(-sums, kind="stable")
        both = [(a, b) if a and b else a or b for a, b in zip(g, reversed(h))]
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), count, sums, [both[i] for i in order]))
        count += 1
    groups = []
    for nested in heap[0][3] if heap else []:
        out, stack = [], [nested]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x:
                out += x
        groups.append(sorted(out))
    return groups


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups by :func:`differencing`, with as few windows as the capacity lets it use."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, windows)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        windows += 1


class Packer:
    """Cuts documents into pieces and hands out packed pieces batch by batch."""

    def __init__(self, part: int, window: int = WINDOW, piece: int = PIECE, windows: int = WINDOWS):
        self.window, self.piece = window, piece
        self.room = windows * (window - SLACK)
        self.next_id = part << 40
        self.waiting: list[tuple] = []  # (document fields, start, length, crc)
        self.tokens = 0

    def add(self, doc: tuple, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            yield (*doc, at, self.window, zlib.crc32(ids[4 * at : 4 * (at + self.window)]), n, self.next_id, 0)
            self.next_id += 1
            at += self.window
        while at < n:
            left = self.room - self.tokens
            if left > FINE_TOKENS:
                size = min(self.piece, n - at, left - FINE_TOKENS)
            else:
                size = min(FINE[len(self.waiting) % len(FINE)], n - at, left)
            self.waiting.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
            self.tokens += size
            at += size
            if self.tokens == self.room:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        pieces, self.waiting, self.tokens = self.waiting, [], 0
        for group in balanced([p[2] for p in pieces], self.window) if pieces else []:
            offset = 0
            for i in group:
                doc, start, size, crc, n = pieces[i]
                yield (*doc, start, size, crc, n, self.next_id, offset)
                offset += size
            self.next_id += 1


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0,
         window: int = WINDOW, make: Callable[[str], Encoder] = Encoder) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every token of every row, and the end token ``end`` after it, is in exactly one piece;
    null and empty texts are the end token alone; repeated rows are packed once each; a null
    doc_id stays null; other columns are not read; an empty table gives an empty result.  A
    sequence's pieces fill it from offset 0 without gaps, up to ``window`` tokens.
    """
    ids = docs.schema[doc_id].dataType.simpleString()
    tail = np.asarray([end], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(batches):
        from pyspark import TaskContext

        encode, packer = _shared(make, tokenizer), Packer(TaskContext.get().partitionId(), window)
        kind = None

        def table(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(cols)], names)

        rows: list[tuple] = []
        for b in batches:
            kind = b.schema.field(0).type
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                rows.extend(packer.add((key,), encode(t.as_py() or "") + tail))
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield table(rows)

    longs = ", ".join(f"{n} bigint" for n in names[1:])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {ids}, {longs}")


_encoders: dict = {}


def _shared(make, path):
    """One encoder per Python worker: its known words serve all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = make(path)
    return _encoders[path]
