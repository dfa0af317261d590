"""The LZF format: literal runs of 1 to 32 bytes and back references of 3 to 264 bytes within 8 KiB.

A control byte below 32 starts a run of that many bytes plus one.  Otherwise its
upper three bits are the length less 2 (7: the next byte adds to it) and its
lower five, with the next byte, the distance less 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

WINDOW, MAX_MATCH, MAX_RUN = 1 << 13, 264, 32


class LzfError(ValueError):
    pass


class NoCompressionPossible(LzfError):
    pass


class BufferTooSmall(LzfError):
    pass


class DataCorrupted(LzfError):
    pass


def compress(data: bytes) -> bytes:
    """Raises NoCompressionPossible where the output would not be smaller."""
    out, run = bytearray(), bytearray()
    last: dict[bytes, int] = {}
    n, i = len(data), 0

    def flush() -> None:
        if run:
            out.append(len(run) - 1)
            out.extend(run)
            run.clear()

    while i < n:
        seen = last.get(data[i : i + 3]) if i + 2 < n else None
        if i + 2 < n:
            last[data[i : i + 3]] = i
        if seen is not None and i - seen <= WINDOW:
            size, most = 3, min(MAX_MATCH, n - i)
            while size < most and data[seen + size] == data[i + size]:
                size += 1
            flush()
            back, code = i - seen - 1, size - 2
            if code < 7:
                out.append(code << 5 | back >> 8)
            else:
                out += bytes((7 << 5 | back >> 8, code - 7))
            out.append(back & 255)
            for k in range(i + 1, min(i + size, n - 2)):
                last[data[k : k + 3]] = k
            i += size
        else:
            run.append(data[i])
            i += 1
            if len(run) == MAX_RUN:
                flush()
    flush()
    if len(out) >= n:
        raise NoCompressionPossible(f"{n} bytes don't shrink")
    return bytes(out)


def decompress(data: bytes, size: int) -> bytes:
    """At most `size` bytes: BufferTooSmall if there are more, DataCorrupted if the data aren't well formed."""
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        control = data[i]
        i += 1
        if control < MAX_RUN:
            end = i + control + 1
            if len(out) + control + 1 > size:
                raise BufferTooSmall(f"more than {size} bytes")
            if end > n:
                raise DataCorrupted("a run is cut off")
            out += data[i:end]
            i = end
            continue
        length = (control >> 5) + 2
        if length == 9:
            if i >= n:
                raise DataCorrupted("a length is cut off")
            length += data[i]
            i += 1
        if i >= n:
            raise DataCorrupted("a distance is cut off")
        start = len(out) - ((control & 31) << 8 | data[i]) - 1
        i += 1
        if len(out) + length > size:
            raise BufferTooSmall(f"more than {size} bytes")
        if start < 0:
            raise DataCorrupted("a reference before the start")
        if start + length <= len(out):
            out += out[start : start + length]
        else:
            part = bytes(out[start:])
            out += (part * (length // len(part) + 1))[:length]
    return bytes(out)


def stored(data: bytes) -> bytes:
    """Data as runs that are not compressed, a thirty-second longer."""
    return b"".join(bytes((len(data[i : i + MAX_RUN]) - 1,)) + data[i : i + MAX_RUN] for i in range(0, len(data), MAX_RUN))


def shorter(data: bytes) -> bytes:
    """Compressed, or as runs where that is no shorter; one after the other, such pieces are one stream."""
    try:
        return compress(data)
    except NoCompressionPossible:
        return stored(data)


def stream(read: Callable[[int], bytes], packed: int, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The same in pieces of about `chunk` bytes, from `packed` bytes that read(n) gives in turn; only the last WINDOW bytes are kept."""
    out, done, left, data, i = bytearray(), 0, packed, b"", 0
    while True:
        if len(data) - i < 34 and left:  # a token has 33 bytes at most
            more = read(min(left, chunk))
            if not more:
                raise DataCorrupted("the data end early")
            left -= len(more)
            data, i = data[i:] + more, 0
            continue
        if i >= len(data):
            break
        control = data[i]
        if control < MAX_RUN:
            end = i + control + 2
            if end > len(data):
                raise DataCorrupted("a run is cut off")
            out += data[i + 1 : end]
            i = end
        else:
            far = control >> 5 == 7
            if i + 1 + far >= len(data):
                raise DataCorrupted("a reference is cut off")
            length = (control >> 5) + 2 + (data[i + 1] if far else 0)
            start = len(out) - ((control & 31) << 8 | data[i + 1 + far]) - 1
            i += 2 + far
            if start < 0:
                raise DataCorrupted("a reference before the start")
            part = bytes(out[start : start + length])
            out += (part * (length // len(part) + 1))[:length]
        if len(out) >= chunk + 2 * WINDOW:
            yield bytes(out[done : len(out) - WINDOW])
            del out[: len(out) - WINDOW]
            done = 0
    yield bytes(out[done:])
