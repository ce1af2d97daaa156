import random

import numpy as np

from paperloom.llm import repeats as R


def test_anchors_hash_few_bytes_at_once(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.choice((0, 1, 99, 100, 101, 400, 5000)))) for _ in range(60)]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)
    sizes_hashed, hashes = [], R.gram_hashes
    monkeypatch.setattr(R, "gram_hashes", lambda d, k: sizes_hashed.append(len(d)) or hashes(d, k))
    whole = R.anchors(data, sizes, 100, 32)
    monkeypatch.setattr(R, "HASHED", 700)
    parts = R.anchors(data, sizes, 100, 32)
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0])
    assert max(sizes_hashed[1:]) <= 700 + 3 * 100  # blocks of 900,000 bytes before
    of, place, left, right, _ = whole
    windows = sorted((o, s) for o, p, a, b in zip(of.tolist(), place.tolist(), left.tolist(), right.tolist()) for s in range(p - a, p - b + 1))
    assert windows == [(i, s) for i, x in enumerate(texts) for s in range(len(x) - 99)]


def test_common_prefixes():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.choice((0, 1, 5, 16, 17, 40)))) for _ in "ab")
        if rng.random() < 0.5:
            b = a[: rng.randrange(len(a) + 1)] + b
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for known in {0, n // 2, n}:
            assert R._common(a, b, known) == n
