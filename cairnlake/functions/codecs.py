"""Canonical byte encodings and hashes that Spark has no function for.

Plain functions on bytes, for use in Arrow batches; ``register`` offers them to SQL.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

# -- BLAKE3, from its published specification. Chunks of many payloads, and the nodes of a level, are compressed together in numpy.

# The initial chaining value and the message permutation.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
CHUNK = 1024
#: Compressions done together, so that their states stay in a core's cache; bytes of payloads that are hashed together, or of one payload.
TILE, TOGETHER = 4096, 8 << 20


def _schedule() -> list[np.ndarray]:
    """Words of the block for each of the seven rounds: first and second of the four columns, then of the four diagonals."""
    order, out = np.arange(16), []
    for _ in range(7):
        out.append(np.stack([order[0:8:2], order[1:8:2], order[8::2], order[9::2]]))
        order = order[list(_PERMUTATION)]
    return out


_WORDS = _schedule()
_SHIFTED = [[(i + k) % 4 for i in range(4)] for k in range(4)]


def _turn(x: np.ndarray, n: int, spare: np.ndarray) -> None:
    np.right_shift(x, np.uint32(n), out=spare)
    np.left_shift(x, np.uint32(32 - n), out=x)
    np.bitwise_or(x, spare, out=x)


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, first: np.ndarray, second: np.ndarray, spare: np.ndarray) -> None:
    """The quarter round of four columns (4, n) at once."""
    for word, left, right in ((first, 16, 12), (second, 8, 7)):
        a += b
        a += word
        d ^= a
        _turn(d, left, spare)
        c += d
        b ^= c
        _turn(b, right, spare)


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of n compressions at once, of values (8, n) and words (16, n)."""
    n = cv.shape[1]
    a, b = cv[:4].copy(), cv[4:].copy()
    c = np.repeat(np.array(_IV[:4], np.uint32)[:, None], n, 1)
    d = np.stack([(counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)])
    spare = np.empty_like(a)
    for words in _WORDS:
        _mix(a, b, c, d, block[words[0]], block[words[1]], spare)
        b, c, d = b[_SHIFTED[1]], c[_SHIFTED[2]], d[_SHIFTED[3]]
        _mix(a, b, c, d, block[words[2]], block[words[3]], spare)
        b, c, d = b[_SHIFTED[3]], c[_SHIFTED[2]], d[_SHIFTED[1]]
    return np.concatenate([a ^ c, b ^ d])


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 digest."""
    return blake3_many([data])[0]


def blake3_many(payloads: list[bytes]) -> list[bytes]:
    """The digest of each payload; small ones are hashed together."""
    out: list[bytes] = []
    group, size = [], 0
    for data in payloads:
        if group and size + len(data) > TOGETHER:
            out += _digests(group)
            group, size = [], 0
        group.append(data)
        size += max(CHUNK, len(data))
    return out + (_digests(group) if group else [])


def _digests(payloads: list[bytes]) -> list[bytes]:
    lengths = np.array([len(x) for x in payloads], np.int64)
    counts = np.maximum(1, -(-lengths // CHUNK))
    starts = np.cumsum(counts) - counts
    raw = np.zeros(int(counts.sum()) * CHUNK, np.uint8)
    for data, at in zip(payloads, (starts * CHUNK).tolist(), strict=True):
        raw[at : at + len(data)] = np.frombuffer(data, np.uint8)
    counter = np.arange(len(raw) // CHUNK) - np.repeat(starts, counts)
    sizes = np.minimum(CHUNK, np.repeat(lengths, counts) - counter * CHUNK)
    alone = np.repeat(counts == 1, counts)
    words = raw.view("<u4").reshape(-1, CHUNK // 4)
    cv = np.empty((8, len(words)), np.uint32)
    order = np.argsort(-sizes, kind="stable")  # those that still have blocks are a prefix
    for k in range(0, len(order), TILE):
        own = order[k : k + TILE]
        cv[:, own] = _chunks(np.ascontiguousarray(words[own].T), counter[own].astype(np.uint64), sizes[own], alone[own])
    return [x.tobytes() for x in np.ascontiguousarray(_roots(cv, counts).T).astype("<u4")]


def _chunks(words: np.ndarray, counter: np.ndarray, sizes: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of chunks (256, n), longest first; ``alone``: those that are a whole payload."""
    cv = np.repeat(np.array(_IV, np.uint32)[:, None], len(sizes), 1)
    last = np.maximum(0, (sizes - 1) // 64)
    for k in range(int(last[0]) + 1):
        n = int(np.count_nonzero(last >= k))
        end = last[:n] == k
        flags = _START * (k == 0) + _END * end + _ROOT * (end & alone[:n])
        cv[:, :n] = _compress(cv[:, :n], words[16 * k : 16 * k + 16, :n], counter[:n], np.minimum(64, sizes[:n] - 64 * k), flags)
    return cv


def _roots(cv: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The roots (8, payloads) of chunks' chaining values, of ``counts`` chunks each: left subtrees are the largest powers of two."""
    while (pairs := counts // 2).any():
        starts, up = np.cumsum(counts) - counts, -(-counts // 2)
        above = np.cumsum(up) - up
        nth = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left, to = np.repeat(starts, pairs) + 2 * nth, np.repeat(above, pairs) + nth
        flags = _PARENT + _ROOT * np.repeat(counts == 2, pairs)
        out = np.empty((8, int(up.sum())), np.uint32)
        for k in range(0, len(left), TILE):
            own = left[k : k + TILE]
            iv = np.repeat(np.array(_IV, np.uint32)[:, None], len(own), 1)
            out[:, to[k : k + TILE]] = _compress(iv, np.concatenate([cv[:, own], cv[:, own + 1]]), np.zeros(len(own), np.uint64), np.full(len(own), 64), flags[k : k + TILE])
        odd = counts % 2 == 1  # an odd one rises as it is
        out[:, (above + up - 1)[odd]] = cv[:, (starts + counts - 1)[odd]]
        cv, counts = out, up
    return cv


# -- length-prefixed records


def prefixed(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


class Reader:
    """Exact reading: truncated fields and trailing bytes are errors."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def u64(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def field(self, most: int | None = None) -> bytes:
        n = self.u64()
        if most is not None and n > most:
            raise ValueError("a field is too long")
        return self.take(n)

    def finish(self) -> None:
        if self.at != len(self.data):
            raise ValueError("trailing bytes")


Entry = tuple[bytes, str, bytes | None, int, bool, bytes | None]  # name, kind, digest, size, executable, target
_KINDS = ("directory", "file", "symlink")


def encode_directory(entries: list[Entry]) -> bytes:
    """Entries in order of their names' bytes; names must differ."""
    rows = sorted(entries, key=lambda e: e[0])
    if any(a[0] == b[0] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("an entry is given twice")
    out = [struct.pack("<Q", len(rows))]
    for name, kind, digest, size, executable, target in rows:
        out.append(bytes([_KINDS.index(kind)]) + prefixed(name))
        out.append(prefixed(target or b"") if kind == "symlink" else digest + struct.pack("<Q", size) + (bytes([executable]) if kind == "file" else b""))
    return b"".join(out)


def decode_directory(data: bytes) -> list[Entry]:
    r, out = Reader(data), []
    for _ in range(r.u64()):
        tag = r.take(1)[0]
        if tag > 2:
            raise ValueError("unknown tag")
        name = r.field(255)
        if out and name <= out[-1][0]:
            raise ValueError("entries out of order")
        if tag == 2:
            out.append((name, "symlink", None, 0, False, r.field(4095)))
            continue
        digest, size = r.take(32), r.u64()
        flag = r.take(1)[0] if tag == 1 else 0
        if flag > 1:
            raise ValueError("a flag is neither 0 nor 1")
        out.append((name, _KINDS[tag], digest, size, bool(flag), None))
    r.finish()
    return out


def directory_size(entries: list[Entry]) -> int:
    """Descendants: one for each entry, and what directories hold; more than 64 bits are an error."""
    n = sum(1 + (e[3] if e[1] == "directory" else 0) for e in entries)
    if n >= 1 << 64:
        raise OverflowError("too many descendants")
    return n


Key = tuple[str, bytes]


def encode_key(key: Key) -> bytes:
    return prefixed(key[0].encode()) + prefixed(key[1])


def read_key(r: Reader) -> Key:
    return r.field(64).decode("ascii"), r.field(128)


def encode_record(key: Key, payload: bytes, size: int, links: list[Key]) -> bytes:
    if any(a >= b for a, b in zip(links, links[1:], strict=False)):
        raise ValueError("links are not strictly ascending")
    return encode_key(key) + payload + struct.pack("<QQ", size, len(links)) + b"".join(map(encode_key, links))


def decode_record(data: bytes) -> tuple[Key, bytes, int, list[Key]]:
    r = Reader(data)
    key, payload, size = read_key(r), r.take(32), r.u64()
    links = [read_key(r) for _ in range(r.u64())]
    if any(a >= b for a, b in zip(links, links[1:], strict=False)):
        raise ValueError("links are not strictly ascending")
    r.finish()
    return key, payload, size, links


def encode_root(name: str, key: Key) -> bytes:
    return prefixed(name.encode()) + encode_key(key)


def decode_root(data: bytes) -> tuple[str, Key]:
    r = Reader(data)
    name, key = r.field(1024).decode(), read_key(r)
    r.finish()
    return name, key


LINKED = b"linked-v1\0"


def encode_linked(links: list[Key], body: bytes, magic: bytes = LINKED) -> bytes:
    if any(a >= b for a, b in zip(links, links[1:], strict=False)):
        raise ValueError("links are not strictly ascending")
    return magic + struct.pack("<Q", len(links)) + b"".join(prefixed(encode_key(k)) for k in links) + prefixed(body)


def decode_linked(data: bytes, magic: bytes = LINKED) -> tuple[list[Key], bytes]:
    r = Reader(data)
    if r.take(len(magic)) != magic:
        raise ValueError("wrong magic")
    links = []
    for _ in range(r.u64()):
        k = Reader(r.field())
        links.append(read_key(k))
        k.finish()
    if any(a >= b for a, b in zip(links, links[1:], strict=False)):
        raise ValueError("links are not strictly ascending")
    body = r.field()
    r.finish()
    return links, body


def encode_uvarint(x: int) -> bytes:
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def read_uvarint(r: Reader) -> int:
    """A minimal 64-bit varint."""
    x, k = 0, 0
    while True:
        b = r.take(1)[0]
        x |= (b & 0x7F) << 7 * k
        if b < 0x80:
            if (b == 0 and k) or x >= 1 << 64:
                raise ValueError("not a canonical varint")
            return x
        k += 1
        if k > 9:
            raise ValueError("not a canonical varint")


RAW_CODEC, BLAKE3_CODE = 0x55, 0x1E


def encode_cid(codec: int, digest: bytes) -> bytes:
    return encode_uvarint(1) + encode_uvarint(codec) + encode_uvarint(BLAKE3_CODE) + encode_uvarint(32) + digest


def decode_cid(data: bytes) -> tuple[int, bytes]:
    r = Reader(data)
    if read_uvarint(r) != 1:
        raise ValueError("only version 1")
    codec = read_uvarint(r)
    if read_uvarint(r) != BLAKE3_CODE or read_uvarint(r) != 32:
        raise ValueError("only BLAKE3 of 32 bytes")
    digest = r.take(32)
    r.finish()
    return codec, digest


def parse_git_tree(data: bytes, id_bytes: int = 20) -> list[tuple[str, bytes, bytes]]:
    """(mode, name, id) of a tree's entries, which must stand in canonical order."""
    r, out, last = Reader(data), [], b""
    while r.at < len(data):
        space, zero = data.find(b" ", r.at), data.find(b"\0", r.at)
        if space < 0 or zero < space:
            raise ValueError("truncated")
        mode, name = data[r.at : space].decode("ascii"), data[space + 1 : zero]
        if not name or name in (b".", b"..", b".git") or b"/" in name:
            raise ValueError("not a valid name")
        r.at = zero + 1
        order = name + (b"/" if mode in ("40000", "040000") else b"\0")
        if order <= last:
            raise ValueError("entries out of order")
        last = order
        out.append((mode, name, r.take(id_bytes)))
    return out


# -- verified ranges: a hash tree over blocks


def block_hashes(data: bytes, block: int = 16_384) -> list[list[bytes]]:
    """Levels of a binary hash tree over blocks, leaves first."""
    import hashlib

    level = [hashlib.sha256(b"\0" + data[k : k + block]).digest() for k in range(0, max(1, len(data)), block)]
    levels = [level]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        levels.append(level)
    return levels


def prove_range(data: bytes, offset: int, length: int, block: int = 16_384) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """The blocks of a range, and the sibling hashes (level, index, hash) that tie them to the root."""
    levels = block_hashes(data, block)
    first, last = offset // block, max(offset, min(len(data), offset + length) - 1) // block
    known, proof = set(range(first, last + 1)), []
    for d, level in enumerate(levels[:-1]):
        for k in sorted({i ^ 1 for i in known} - known):
            if k < len(level):
                proof.append((d, k, level[k]))
        known = {i // 2 for i in known}
    return [data[k * block : (k + 1) * block] for k in range(first, last + 1)], proof


def verify_range(root: bytes, size: int, offset: int, length: int, blocks: list[bytes], proof: list[tuple[int, int, bytes]], block: int = 16_384) -> bytes:
    """The bytes of the range, if the blocks and hashes give the root; nothing is returned otherwise."""
    import hashlib

    first, count = offset // block, max(1, -(-size // block))
    have = {(0, first + k): hashlib.sha256(b"\0" + b).digest() for k, b in enumerate(blocks)} | {(d, k): h for d, k, h in proof}
    d = 0
    while count > 1:
        for k in range(0, count, 2):
            if (d, k) in have and (k + 1 >= count or (d, k + 1) in have):
                have[d + 1, k // 2] = hashlib.sha256(b"\1" + have[d, k] + have[d, k + 1]).digest() if k + 1 < count else have[d, k]
        count, d = -(-count // 2), d + 1
    if have.get((d, 0)) != root:
        raise ValueError("the range does not belong to this root")
    return b"".join(blocks)[offset - first * block :][:length]


# -- compression


def compress(data: bytes, level: int = 3) -> bytes:
    """A frame that says how long its content is."""
    return zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True).compress(data)


def decompress(frame: bytes, most: int) -> bytes:
    """The content of a whole frame; one that says or holds more than ``most`` bytes, or is followed by others, is an error before it is unpacked further."""
    said = zstandard.get_frame_parameters(frame).content_size
    if said not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) and said > most:
        raise ValueError(f"the frame holds {said} bytes")
    unpack, out, size = zstandard.ZstdDecompressor().decompressobj(), [], 0
    for k in range(0, len(frame), 4096):
        out.append(unpack.decompress(frame[k : k + 4096]))
        size += len(out[-1])
        if size > most:
            raise ValueError(f"the frame holds more than {most} bytes")
        if unpack.eof and (unpack.unused_data or k + 4096 < len(frame)):
            raise ValueError("bytes follow the frame")
    if not unpack.eof:
        raise ValueError("the frame is truncated")
    return b"".join(out)


# -- deltas


def encode_delta(base: bytes, target: bytes, block: int = 64) -> list[tuple[str, int, bytes | int]]:
    """Tokens that make ``target`` from ``base``: ("copy", start, length) or ("literal", 0, bytes).

    Blocks of the base are indexed; a match is grown both ways to the first difference.
    """
    places: dict[bytes, int] = {}
    for k in range(0, len(base) - block + 1, block):
        places.setdefault(base[k : k + block], k)
    out: list[tuple[str, int, bytes | int]] = []
    at = done = 0
    while at + block <= len(target):
        b = places.get(target[at : at + block])
        if b is None:
            at += 1
            continue
        a, n = at, block
        while a > done and b > 0 and target[a - 1] == base[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        while a + n < len(target) and b + n < len(base) and target[a + n] == base[b + n]:
            n += 1
        if a > done:
            out.append(("literal", 0, target[done:a]))
        out.append(("copy", b, n))
        at = done = a + n
    if done < len(target):
        out.append(("literal", 0, target[done:]))
    return out


def decode_delta(base: bytes, tokens: list[tuple[str, int, bytes | int]]) -> bytes:
    return b"".join(base[s : s + x] if kind == "copy" else x for kind, s, x in tokens)


# -- verifiers by namespace

Verifier = Callable[[bytes, bytes], list[Key]]


class Formats:
    """Verifiers by namespace: each checks that a payload is canonical and of its id, and returns its links."""

    def __init__(self) -> None:
        self._of: dict[str, Verifier] = {}

    def add(self, namespace: str, verifier: Verifier) -> None:
        if namespace in self._of:
            raise ValueError(f"{namespace} is registered already")
        self._of[namespace] = verifier

    def verify(self, namespace: str, native_id: bytes, payload: bytes) -> list[Key]:
        if namespace not in self._of:
            raise KeyError(f"no format for {namespace}")
        return self._of[namespace](native_id, payload)


def standard_formats() -> Formats:
    def blob(native_id: bytes, payload: bytes) -> list[Key]:
        if blake3(payload) != native_id:
            raise ValueError("the digest differs")
        return []

    def directory(native_id: bytes, payload: bytes) -> list[Key]:
        blob(native_id, payload)
        return sorted({("directory.v1" if e[1] == "directory" else "blob.v1", e[2]) for e in decode_directory(payload) if e[1] != "symlink"})

    def linked(native_id: bytes, payload: bytes) -> list[Key]:
        blob(native_id, payload)
        return decode_linked(payload)[0]

    out = Formats()
    out.add("blob.v1", blob)
    out.add("directory.v1", directory)
    out.add("linked.v1", linked)
    return out


@pandas_udf(BinaryType())
def blake3_udf(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE3 of a BINARY column; null stays null."""
    for s in data:
        found = iter(blake3_many([bytes(x) for x in s if x is not None]))
        yield s.map(lambda x: None if x is None else next(found))


def register(spark: SparkSession) -> None:
    spark.udf.register("blake3", blake3_udf)
