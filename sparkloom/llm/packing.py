"""Cost-balanced packing of documents into token sequences.

The cost of a piece of n tokens is n * linear + n * n * quadratic: the matrix products grow with the
tokens, attention with their square. Inside a block of documents, pieces go in descending order of
length to the lowest-cost sequence that has room, so no sequence collects all the long documents.

Blocks are cut from the rows a task reads, so nothing is shuffled: a block holds at most block_tokens
tokens (one document may exceed it; it is cut first), which bounds memory on any input. A block of T
tokens gets T // max_tokens full sequences, and what doesn't fit in goes on to the task's next block; only the task's last block has
a rest of less than max_tokens, which goes to sequences whose lengths are the powers of two that add up to it, so none needs padding.

Defined cases: a null text is an empty one, and a document always ends in end_id, so an empty document
is one piece of one token. Repeated rows are packed as often as they occur. An empty table gives no rows.
Columns other than the two named are not read, so their names can't clash.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Each task numbers its own sequences from its partition's number times this.
SEQUENCES_A_TASK = 1 << 36
CACHED_WORDS = 200_000
LONGEST_KNOWN = 64
PROBES = ["Hello World, this  is A Test.\nNew line", "don't 3.5 km, (x) a_b", "Über Straße, naïve É", " lead  two ", "\ttab\r\nend", "東京 🙂 e\u0301", ""]
_BEYOND = re.compile("[\u0300-\U0010ffff]")
_AFTER_WORD = re.compile(r"(?<=[^\W_])([.,])(?=[ \n])")
_encoders: dict[tuple[str, int], Callable] = {}


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes are themselves, the rest follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_encoder(path: str, end_id: int) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian 32-bit ids, end_id last; the same ids as encoding each text at once.

    The tokenizer lower-cases and never joins text across a blank or a line feed, so each stretch
    between them is encoded once and remembered, for as long as the worker lives. A comma or full stop
    between a word and white space is a stretch of its own. Texts with characters from U+0300 on, where
    composing and lower-casing depend on neighbours, go through the whole tokenizer by stretches as they are.
    Whether a tokenizer is of this kind is tried on PROBES; others encode each text at once.
    """
    if (path, end_id) in _encoders:
        return _encoders[path, end_id]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, symbols = tokenizer.model, _byte_symbols()
    end = array("I", [end_id]).tobytes()

    class Known(dict):
        def __missing__(self, w: str) -> bytes:
            if w.isascii() and w.isalpha() and w.islower():
                ids = [t.id for t in model.tokenize(w)]
            elif w.isalpha() and w.islower() and not _BEYOND.search(w):
                ids = [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(symbols))]
            else:
                ids = tokenizer.encode(w, add_special_tokens=False).ids
            b = array("I", ids).tobytes()
            if len(w) <= LONGEST_KNOWN:
                self[w] = b
            return b

    known = Known()

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > CACHED_WORDS:
            known.clear()
        out = []
        for t in texts:
            if not _BEYOND.search(t):
                t = _AFTER_WORD.sub(r" \1", t.lower())
            out.append(b"".join(map(known.__getitem__, t.replace("\n", " ").split(" "))) + end)
        return out

    def at_once(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() + end for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    _encoders[path, end_id] = encode if encode(PROBES) == at_once(PROBES) else at_once
    return _encoders[path, end_id]


def capacities(total: int, most: int) -> list[int]:
    """Full sequences, then the powers of two that make up the rest, largest first."""
    rest = total % most
    return [most] * (total // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


Placed = tuple[int, int, int, int, int]


def assign(lengths: list[int], most: int, linear: float, quadratic: float) -> list[Placed]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths, all of them."""
    return place([(d, 0, n) for d, n in enumerate(lengths)], capacities(sum(lengths), most), most, linear, quadratic)[0]


def place(parts: list[tuple[int, int, int]], caps: list[int], most: int, linear: float, quadratic: float) -> tuple[list[Placed], list[tuple[int, int, int]]]:
    """Puts parts (document, start, length) into sequences of these capacities; what is left when all are full.

    Parts longer than a sequence are cut into full pieces and a rest. A piece goes to the
    lowest-cost full sequence with room for it, or to the lowest-cost short one if no full one has;
    only if none has room, the cheapest (full ones before short ones) is filled and the remainder goes on.
    The sequences with each number of tokens left form a heap by cost, and a segment tree over these
    numbers holds the least of each range, so the choice is exact.
    """
    used = [0] * len(caps)
    out, left = [], []
    none = (2, 0.0, 0)
    by_room: list[list[tuple[int, float, int]]] = [[] for _ in range(most + 1)]  # (short, cost, sequence)
    leaves = 1 << most.bit_length()
    tree = [none] * (2 * leaves)

    def update(room: int) -> None:
        i = leaves + room
        tree[i] = by_room[room][0] if by_room[room] else none
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    def cheapest(room: int) -> tuple[int, float, int]:
        """The least of the sequences with at least so much room."""
        i = leaves + room
        least = tree[i]
        while i > 1:
            if not i & 1 and tree[i + 1] < least:
                least = tree[i + 1]
            i >>= 1
        return least

    for s, c in enumerate(caps):
        heapq.heappush(by_room[c], (int(c != most), 0.0, s))
    for c in set(caps):
        update(c)
    pieces = []
    for d, start, n in parts:
        for at in range(0, n, most):
            pieces.append((min(most, n - at), d, start + at))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    for n, d, at in pieces:
        while n:
            chosen = cheapest(n)
            if chosen == none:
                chosen = cheapest(1)
            if chosen == none:
                left.append((d, at, n))
                break
            short, cost, s = chosen
            room = caps[s] - used[s]
            put = min(n, room)
            heapq.heappop(by_room[room])
            update(room)
            if put < room:
                heapq.heappush(by_room[room - put], (short, cost + linear * put + quadratic * put * put, s))
                update(room - put)
            out.append((d, at, put, s, used[s]))
            used[s] += put
            at += put
            n -= put
    return out, left


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int = 4096, linear: float = 1.0, quadratic: float = 1.0 / 4096,
         block_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ids (packed little-endian, 32 bits each); see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path, end_id)
        base = TaskContext.get().partitionId() * SEQUENCES_A_TASK
        block: list[tuple[int, bytes, int, int]] = []  # document, its ids, and the part of them that is to be placed
        held = done = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, done, block
            caps = capacities(held, max_tokens) if last else [max_tokens] * (held // max_tokens)
            placed, left = place([(k, at, n) for k, (_, _, at, n) in enumerate(block)], caps, max_tokens, linear, quadratic)
            for i in range(0, len(placed), 4096):
                part = placed[i : i + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block[d][0] for d, *_ in part], pa.int64()),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.int64()),
                        pa.array([block[d][1][4 * at : 4 * (at + n)] for d, at, n, _, _ in part], pa.binary()),
                        pa.array([len(block[d][1]) // 4 for d, *_ in part], pa.int64()),
                        pa.array([base + done + p[3] for p in part], pa.int64()),
                        pa.array([p[4] for p in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            done += len(caps)
            block = [(*block[d][:2], at, n) for d, at, n in left]
            held = sum(n for *_, n in block)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts)):
                    block.append((doc, ids, 0, len(ids) // 4))
                    held += len(ids) // 4
                    if held >= block_tokens:
                        yield from flush(False)
        if block:
            yield from flush(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
