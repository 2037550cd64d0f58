"""Plain versions of the corpus operators, for small inputs."""

from collections import Counter


def repeated_bytes(texts, length):
    """(kept bytes, number of removed runs) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        upto = 0
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                upto = max(upto, i)
                for j in range(max(i, upto), i + length):
                    gone[j] = 1
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((kept, runs))
    return out
