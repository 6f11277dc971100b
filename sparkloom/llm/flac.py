"""FLAC media columns: 8-bit mono streams written and read a few thousand frames at a time.

Every frame holds BLOCK samples. All frames of a batch are coded side by side with numpy: the loops below run over
sample or byte positions inside a frame, not over frames. The encoder tries the constant form, the fixed predictors
of order 0 to 4, a linear predictor fitted to the frame, and verbatim samples, and keeps the shortest; residuals are
Rice coded. The seek table has a point for each frame, so the reader finds any sample offset, and decodes frames
independently of each other. The reader checks the CRC-8 of each header, the CRC-16 of each frame and the MD5 of all samples.

A sample is a payload byte less 128. Payloads are padded with bytes 255 to a positive multiple of BLOCK.

Defined cases: a null payload is an empty one (one block of padding); equal payloads give equal streams; a document longer
than FRAMES_AT_ONCE blocks is coded in several steps; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 576
RATE = 8000
FRAMES_AT_ONCE = 2048
LPC_ORDER, LPC_PRECISION = 6, 12
#: First two bytes of a fixed-block-size frame, then its block size (576), rate and channel code and sample size (8 bits).
HEAD = bytes([0xFF, 0xF8, 0x20, 0x02])


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x & top else x << 1) & ((1 << bits) - 1)
        out.append(x)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each stretch of data, all stretches a byte further at each step."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.zeros(len(at), np.uint16)
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for i, n in enumerate(alive):
        c = crc[:n]
        crc[:n] = (c << 8 if bits == 16 else 0) ^ table[(c >> (bits - 8)) ^ data[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(tail)):
            return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> None:
    for b in range(n):
        bits[at + b] = value >> (n - 1 - b) & 1


def _get(bits: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(at.shape, np.int32)
    for b in range(n):
        out = out << 1 | bits[at + b]
    return out


def _signed(x: np.ndarray, n: int) -> np.ndarray:
    return x - ((x >> (n - 1)) << n)


def _rice_cost(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shortest Rice code of each row's folded residuals: bits without headers, parameter."""
    n = residuals.shape[1]
    mean = residuals.sum(1, dtype=np.int64) // n
    low = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64) - 1, 0, 14)
    best = np.full(len(residuals), 1 << 60)
    chosen = low.copy()
    for step in range(3):
        k = np.minimum(low + step, 14)
        cost = n * (k + 1) + (residuals >> k[:, None].astype(np.int32)).sum(1, dtype=np.int64)
        chosen, best = np.where(cost < best, k, chosen), np.minimum(cost, best)
    return best, chosen


def _fold(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of a linear predictor for each row, by Levinson's recursion."""
    v = x.astype(np.float64)
    r = np.stack([(v[:, : BLOCK - lag] * v[:, lag:]).sum(1) for lag in range(LPC_ORDER + 1)], 1)
    r[:, 0] += 1e-9 + r[:, 0] * 1e-9
    a, error = np.zeros((len(x), LPC_ORDER)), r[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_PRECISION - 2 - np.ceil(np.log2(most)), 0, 15).astype(np.int32)
    limit = 1 << (LPC_PRECISION - 1)
    return np.clip(np.rint(a * np.exp2(shift)[:, None]), -limit, limit - 1).astype(np.int32), shift


def _predict(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coefficients.shape[1]
    total = np.zeros((len(x), x.shape[1] - order), np.int32)
    for j in range(order):
        total += coefficients[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return total >> shift[:, None]


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """A frame for each row of samples (rows of BLOCK values from -128 to 127), with these frame numbers."""
    x = samples.astype(np.int32)
    count = len(x)
    kind = np.full(count, 1)  # subframe type: verbatim
    size = np.full(count, 8 + 8 * BLOCK)
    rice, folded = np.zeros(count, np.int64), {}
    d = x
    for order in range(5):
        folded[8 + order] = f = _fold(d)
        cost, k = _rice_cost(f)
        cost += 8 + 8 * order + 10
        better = cost < size
        kind[better], size[better], rice[better] = 8 + order, cost[better], k[better]
        d = np.diff(d)
    coefficients, shift = _linear(x)
    linear = 32 + LPC_ORDER - 1
    folded[linear] = f = _fold(x[:, LPC_ORDER:] - _predict(x, coefficients, shift))
    cost, k = _rice_cost(f)
    cost += 8 + 8 * LPC_ORDER + 9 + LPC_PRECISION * LPC_ORDER + 10
    better = cost < size
    kind[better], size[better], rice[better] = linear, cost[better], k[better]
    same = (x == x[:, :1]).all(1)
    kind[same], size[same] = 0, 16

    heads = [HEAD + _number(int(n)) for n in numbers]
    head = np.array([len(h) for h in heads])
    length = head + 1 + (size + 7) // 8 + 2
    end = np.cumsum(length)
    start = end - length
    bits = np.zeros(int(end[-1]) * 8, np.uint8)
    body = (start + head + 1) * 8
    _put(bits, body, kind << 1, 8)
    body += 8
    for t in np.unique(kind):
        rows = np.flatnonzero(kind == t)
        at = body[rows]
        if t <= 1:
            n = 1 if t == 0 else BLOCK
            _put(bits, at[:, None] + 8 * np.arange(n), x[rows, :n] & 0xFF, 8)
            continue
        order = t - 8 if t < 32 else t - 31
        _put(bits, at[:, None] + 8 * np.arange(order), x[rows, :order] & 0xFF, 8)
        at = at + 8 * order
        if t >= 32:
            _put(bits, at, np.full(len(rows), LPC_PRECISION - 1), 4)
            _put(bits, at + 4, shift[rows], 5)
            _put(bits, at[:, None] + 9 + LPC_PRECISION * np.arange(order), coefficients[rows] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
            at = at + 9 + LPC_PRECISION * order
        _put(bits, at + 6, rice[rows], 4)  # method 0 and partition order 0 are zero bits
        for k in np.unique(rice[rows]):
            of = rice[rows] == k
            f = folded[t][rows[of]]
            q = f >> int(k)
            ends = np.cumsum(q + (1 + int(k)), 1) + (at[of] + 10)[:, None]
            bits[ends - (1 + int(k))] = 1
            _put(bits, ends - int(k), f, int(k))
    data = np.packbits(bits)
    for i in range(int(head.max())):
        has = np.flatnonzero(head > i)
        data[start[has] + i] = [heads[h][i] for h in has]
    data[start + head] = _crc(data, start, head, CRC8, 8)
    crc = _crc(data, start, length - 2, CRC16, 16)
    data[end - 2], data[end - 1] = crc >> 8, crc & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


def _stream(frames: list[bytes], samples: bytes) -> bytes:
    sizes = [len(f) for f in frames]
    total = len(frames) * BLOCK
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(samples).digest()
    at, points = 0, []
    for i, n in enumerate(sizes):
        points.append(struct.pack(">QQH", i * BLOCK, at, BLOCK))
        at += n
    table = b"".join(points)
    return b"fLaC" + struct.pack(">I", len(info)) + info + struct.pack(">I", 0x83 << 24 | len(table)) + table + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, padded first."""
    padded = [p + b"\xff" * (-len(p) % BLOCK or (0 if p else BLOCK)) for p in payloads]
    counts = [len(p) // BLOCK for p in padded]
    samples = (np.frombuffer(b"".join(padded), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(n) for n in counts]) if counts else np.array([], int)
    frames: list[bytes] = []
    for i in range(0, len(samples), FRAMES_AT_ONCE):
        frames += encode_frames(samples[i : i + FRAMES_AT_ONCE], numbers[i : i + FRAMES_AT_ONCE])
    out, at = [], 0
    for n in counts:
        out.append(_stream(frames[at : at + n], samples[at : at + n].tobytes()))
        at += n
    return out


def seek_table(media: bytes) -> tuple[np.ndarray, np.ndarray, int, int, bytes]:
    """Sample offsets, byte offsets of their frames in the stream, end of the stream, samples in all, MD5."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", np.zeros(0, np.uint8)
    while not last:
        head = struct.unpack_from(">I", media, at)[0]
        last, block, n = head >> 31, head >> 24 & 0x7F, head & 0xFFFFFF
        part = media[at + 4 : at + 4 + n]
        if block == 0:
            info = part
        elif block == 3:
            points = np.frombuffer(part, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
        at += 4 + n
    total = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)
    return points["sample"].astype(np.int64), points["byte"].astype(np.int64) + at, len(media), total, info[18:34]


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The samples of the frames data[start:end], a row each."""
    if not (data[start[:, None] + np.arange(4)] == np.frombuffer(HEAD, np.uint8)).all():
        raise ValueError("unexpected frame header")
    first = data[start + 4]
    head = 4 + np.select([first < 0x80, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC, first < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    if (_crc(data, start, head, CRC8, 8) != data[start + head]).any():
        raise ValueError("frame header checksum")
    if (_crc(data, start, end - start - 2, CRC16, 16) != (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).any():
        raise ValueError("frame checksum")
    low, high = int(start.min()), int(end.max())
    bits = np.unpackbits(data[low:high])
    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    following = np.append(np.minimum.accumulate(ones[::-1])[::-1], np.int32(len(bits)))
    body = (start - low + head + 1) * 8
    kind = _get(bits, body, 8) >> 1
    out = np.zeros((len(start), BLOCK), np.int32)
    for t in np.unique(kind):
        rows = np.flatnonzero(kind == t)
        at = body[rows] + 8
        if t <= 1:
            n = 1 if t == 0 else BLOCK
            out[rows] = _signed(_get(bits, at[:, None] + 8 * np.arange(n), 8), 8)
            continue
        order = int(t - 8 if t < 32 else t - 31)
        warm = _signed(_get(bits, at[:, None] + 8 * np.arange(order), 8), 8)
        at = at + 8 * order
        if t >= 32:
            precision = int(_get(bits, at[:1], 4)[0]) + 1
            if (_get(bits, at, 4) + 1 != precision).any():
                raise ValueError("mixed predictor precisions")
            shift = _signed(_get(bits, at + 4, 5), 5)
            coefficients = _signed(_get(bits, at[:, None] + 9 + precision * np.arange(order), precision), precision)
            at = at + 9 + precision * order
        if (_get(bits, at, 2) != 0).any():
            raise ValueError("unexpected residual coding")
        parts = 1 << _get(bits, at + 2, 4)
        at = at + 6
        residual = np.zeros((len(rows), BLOCK - order), np.int32)
        for p in np.unique(parts):
            of = np.flatnonzero(parts == p)
            residual[of] = _rice(bits, following, at[of], int(p), order)
        if t < 32:
            done = residual
            for j in range(order - 1, -1, -1):
                done = np.diff(warm, j)[:, -1:] + np.cumsum(done, 1)
            out[rows] = np.concatenate([warm, done], 1)
        else:
            x = np.zeros((BLOCK, len(rows)), np.int32)
            x[:order] = warm.T
            c = np.ascontiguousarray(coefficients.T[::-1])
            for i in range(order, BLOCK):
                x[i] = ((x[i - order : i] * c).sum(0) >> shift) + residual[:, i - order]
            out[rows] = x.T
    return out


def _rice(bits: np.ndarray, following: np.ndarray, at: np.ndarray, parts: int, order: int) -> np.ndarray:
    """Residuals of frames with this many partitions; the frames go forward a code at a time, together."""
    ends = np.zeros((BLOCK - order, len(at)), np.int32)
    quotient, k_of = np.zeros_like(ends), np.zeros_like(ends)
    i, at = 0, at.astype(np.int32)
    for p in range(parts):
        k = _get(bits, at, 4)
        if (k == 15).any():
            raise ValueError("escaped partition")
        at = at + 4
        for _ in range(BLOCK // parts - (order if p == 0 else 0)):
            one = following[at]
            quotient[i], ends[i], k_of[i] = one - at, one, k
            at = one + (1 + k)
            i += 1
    folded = quotient
    for b in range(int(k_of.max())):
        more = k_of > b
        folded = np.where(more, folded << 1 | bits[np.where(more, ends + (1 + b), 0)], folded)
    return ((folded >> 1) ^ -(folded & 1)).T


def decode(media: list[bytes]) -> list[tuple[bytes, list[int], list[int]]]:
    """Of each stream the payload (padding included), the seek table's sample offsets and byte offsets."""
    tables = [seek_table(m) for m in media]
    starts, ends, base, counts = [], [], 0, []
    for (sample, byte, end, total, _), m in zip(tables, media):
        if len(sample) * BLOCK != total:
            raise ValueError("the seek table must have a point for each frame")
        starts.append(byte + base)
        ends.append(np.append(byte[1:], end) + base)
        counts.append(len(sample))
        base += len(m)
    if not media:
        return []
    data, start, end = np.frombuffer(b"".join(media), np.uint8), np.concatenate(starts), np.concatenate(ends)
    x = np.concatenate([decode_frames(data, start[i : i + FRAMES_AT_ONCE], end[i : i + FRAMES_AT_ONCE]) for i in range(0, len(start), FRAMES_AT_ONCE)]).astype(np.int8)
    out, at = [], 0
    for n, (sample, byte, _, _, md5) in zip(counts, tables):
        own = x[at : at + n].tobytes()
        if hashlib.md5(own).digest() != md5:
            raise ValueError("stream checksum")
        out.append(((np.frombuffer(own, np.uint8) ^ 0x80).tobytes(), sample.tolist(), byte.tolist()))
        at += n
    return out


def read_block(media: bytes, sample: int) -> bytes:
    """The payload bytes of the block that holds this sample, read through the seek table alone."""
    samples, byte, end, _, _ = seek_table(media)
    i = int(np.searchsorted(samples, sample, side="right")) - 1
    stop = int(byte[i + 1]) if i + 1 < len(byte) else end
    part = np.frombuffer(media, np.uint8)
    x = decode_frames(part, np.array([int(byte[i])]), np.array([stop]))
    return (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def describe(payload: bytes) -> str:
    """Sum, sum of squares, sign changes, least and greatest sample, and the energy of first differences."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{int(x.sum())}:{int((x * x).sum())}:{turns}:{int(x.min())}:{int(x.max())}:{int((np.diff(x) ** 2).sum())}"


def _by_bytes(values: list[bytes], most: int = FRAMES_AT_ONCE * BLOCK) -> Iterator[tuple[int, int]]:
    """Bounds of runs of values of about most bytes."""
    at = held = 0
    for i, v in enumerate(values):
        held += len(v) + BLOCK
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(values):
        yield at, len(values)


def write_flac(docs: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """id_col, n_bytes (of the payload without padding) and media, the FLAC stream of a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values = [v or b"" for v in part.column(1).to_pylist()]
                for a, b in _by_bytes(values):
                    columns = [part.column(0).slice(a, b - a), pa.array(map(len, values[a:b]), pa.int64()), pa.array(encode(values[a:b]), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_flac(stored: DataFrame) -> DataFrame:
    """stored (with a column media) and pcm (the payload), feature, sample_offsets and byte_offsets (the blocks' places)."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

    own = [f for f in stored.schema.fields if f.name not in ("pcm", "feature", "sample_offsets", "byte_offsets")]
    at_media = [f.name for f in own].index("media")
    longs = ArrayType(LongType())
    added = [StructField("pcm", BinaryType()), StructField("feature", StringType()), StructField("sample_offsets", longs), StructField("byte_offsets", longs)]
    names = [f.name for f in (*own, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values = part.column(at_media).to_pylist()
                for a, b in _by_bytes(values):
                    read = decode(values[a:b])
                    new = [
                        pa.array([r[0] for r in read], pa.binary()),
                        pa.array([describe(r[0]) for r in read], pa.string()),
                        pa.array([r[1] for r in read], pa.list_(pa.int64())),
                        pa.array([r[2] for r in read], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in part.columns), *new], names=names)

    return stored.select(*[f.name for f in own]).mapInArrow(run, StructType([*own, *added]))
