"""The EDF and EDF+ format: headers, records of samples, annotations. Records are decoded some at a time, never a whole file."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

_NOTES = "EDF Annotations"


class NotEdf(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    """Of one file: a field for each signal, and what follows from them."""

    records: int
    seconds: float
    labels: list[str]
    units: list[str]
    physical: list[tuple[float, float]]
    digital: list[tuple[float, float]]
    sizes: list[int]

    @property
    def length(self) -> int:
        return 256 * (len(self.labels) + 1)

    @property
    def width(self) -> int:
        """Bytes of a record."""
        return 2 * sum(self.sizes)

    @property
    def own(self) -> list[int]:
        """Signals that are no annotations."""
        return [i for i, name in enumerate(self.labels) if name != _NOTES]

    @property
    def rate(self) -> int:
        """Samples in a record of the fastest signal; slower ones are interpolated at its times."""
        return max(self.sizes[i] for i in self.own)

    @property
    def sfreq(self) -> float:
        return self.rate / self.seconds

    @property
    def channels(self) -> list[str]:
        """Labels; equal ones get a running number."""
        names = [self.labels[i] for i in self.own]
        many, seen = {n for n, c in Counter(names).items() if c > 1}, Counter()
        out = []
        for n in names:
            out.append(f"{n}-{seen[n]}" if n in many else n)
            seen[n] += 1
        return out

    def count(self, size: int) -> int:
        """Whole records in a file of `size` bytes, at most as many as the header says."""
        there = max(0, size - self.length) // self.width
        return there if self.records < 0 else min(self.records, there)


def read_header(read: Callable[[int], bytes]) -> Header:
    """From the start of a file; `read(n)` gives the next n bytes. What isn't EDF raises NotEdf."""
    head = read(256)
    if len(head) < 256 or head[:8].decode("latin-1").strip() != "0":
        raise NotEdf("not an EDF file")
    try:
        n = int(head[252:256])
        body = read(256 * n)
        if n < 1 or len(body) < 256 * n:
            raise NotEdf("the header is cut off")
        at = 0

        def fields(width: int) -> list[str]:
            nonlocal at
            out = [body[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
            at += n * width
            return out

        labels, _, units, *limits = fields(16), fields(80), fields(8), fields(8), fields(8), fields(8), fields(8)
        _, sizes = fields(80), [int(x) for x in fields(8)]
        low, high, digital_low, digital_high = ([float(x) for x in row] for row in limits)
        header = Header(int(head[236:244]), float(head[244:252]), labels, units, list(zip(low, high, strict=True)), list(zip(digital_low, digital_high, strict=True)), sizes)
    except NotEdf:
        raise
    except ValueError as e:
        raise NotEdf(f"a field of the header is no number: {e}") from e
    if not header.own or min(sizes) < 0 or header.rate < 1:
        raise NotEdf("no signal in the file")
    if header.seconds <= 0:
        raise NotEdf("records have no duration")
    if any(a == b for a, b in header.digital):
        raise NotEdf("a signal has no digital range")
    return header


def decode(header: Header, raw: bytes, following: bytes = b"") -> np.ndarray:
    """Channels x samples of some records, in Volt (from µV, mV or V as the header says; other units as they are).

    `following` is the next record, if there is one: between the last sample of a slower signal and its next one, values are
    interpolated as anywhere else, so that samples don't depend on where a file is cut.
    """
    n = len(raw) // header.width
    data = np.frombuffer(raw, "<i2", count=n * header.width // 2).reshape(n, header.width // 2)
    more = np.frombuffer(following, "<i2")
    starts = np.concatenate(([0], np.cumsum(header.sizes)))
    rate, out = header.rate, []
    for i in header.own:
        (low, high), (least, most), size = header.physical[i], header.digital[i], header.sizes[i]
        scale = (high - low) / (most - least)
        x = data[:, starts[i] : starts[i + 1]].reshape(-1).astype(np.float64)
        if size != rate:
            after = more[starts[i] : starts[i] + 1].astype(np.float64) if len(more) and size else x[-1:]
            x = np.concatenate((x, after)) if size else np.zeros(n + 1)
            place = np.arange(n * rate, dtype=np.int64) * max(size, 1)
            j = place // rate
            x = x[j] + (x[np.minimum(j + 1, len(x) - 1)] - x[j]) * ((place % rate) / rate)
        x = (x - least) * scale + low
        out.append(x * {"uv": 1e-6, "µv": 1e-6, "mv": 1e-3}.get(header.units[i].lower(), 1.0))
    return np.array(out).reshape(len(out), n * rate)


def notes(header: Header, raw: bytes) -> list[tuple[int, float, float, str]]:
    """Record (of these), onset, duration (0 if not given) and text of each annotation, in the order of the file."""
    starts = np.concatenate(([0], np.cumsum(header.sizes)))
    found = []
    for r in range(len(raw) // header.width):
        for i, label in enumerate(header.labels):
            if label == _NOTES:
                at = r * header.width
                found += [(r, *e) for e in _texts(raw[at + 2 * starts[i] : at + 2 * starts[i + 1]])]
    return found


def _texts(raw: bytes) -> list[tuple[float, float, str]]:
    found = []
    for item in raw.split(b"\x00"):
        m = re.match(rb"([+-][0-9.]+)(?:\x15([0-9.]+))?\x14(.*)\x14$", item, re.DOTALL)
        for text in m[3].split(b"\x14") if m else ():
            if text:
                try:
                    found.append((float(m[1]), float(m[2] or 0), text.decode("utf-8", "replace")))
                except ValueError:  # no number after all
                    continue
    return found
