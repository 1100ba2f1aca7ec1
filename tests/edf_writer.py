"""EDF+ files for tests."""

from dataclasses import dataclass, field

import numpy as np

NOTES = "EDF Annotations"


@dataclass
class Recording:
    sfreq: float
    channels: list
    signals: np.ndarray
    annotations: list = field(default_factory=list)
    #: Of channels by name: every how many-th sample is there.
    slower: dict = field(default_factory=dict)


def render(recording, limit=1e-3):
    """Bytes with one-second records and values within ±`limit` Volt."""
    rate = round(recording.sfreq)
    n = recording.signals.shape[1] // rate
    by_record = [f"+{k}\x14\x14\x00".encode() for k in range(n)]
    for onset, duration, text in recording.annotations:
        by_record[min(max(int(onset), 0), n - 1)] += f"+{onset:g}\x15{duration:g}\x14{text}\x14\x00".encode()
    size = max(map(len, by_record)) // 2 + 1
    labels = [*recording.channels, NOTES]
    steps = [recording.slower.get(c, 1) for c in recording.channels]
    pad = lambda values, width: "".join(str(v).ljust(width)[:width] for v in values)
    m = len(labels)
    head = pad(["0"], 8) + pad(["X", "X"], 80) + pad(["01.01.00", "00.00.00", 256 * (m + 1)], 8) + pad(["EDF+C"], 44) + pad([n, 1], 8) + pad([m], 4)
    head += pad(labels, 16) + pad([""] * m, 80) + pad(["uV"] * (m - 1) + [""], 8)
    head += pad([round(-limit * 1e6)] * (m - 1) + [-1], 8) + pad([round(limit * 1e6)] * (m - 1) + [1], 8) + pad([-32768] * m, 8) + pad([32767] * m, 8)
    head += pad([""] * m, 80) + pad([*(rate // s for s in steps), size], 8) + pad([""] * m, 32)
    scale = 2 * limit / 65535
    digital = np.clip(np.round((recording.signals + limit) / scale) - 32768, -32768, 32767).astype("<i2")
    body = b"".join(b"".join(digital[c, k * rate : (k + 1) * rate : s].tobytes() for c, s in enumerate(steps)) + by_record[k].ljust(2 * size, b"\x00") for k in range(n))
    return head.encode("latin-1") + body
