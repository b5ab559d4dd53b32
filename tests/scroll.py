"""A made-up scroll recording with known motion."""

import numpy as np

HEADER, FOOTER, HEIGHT, WIDTH = 16, 24, 160, 96
SCRIPT = [(6, 0), (12, 5), (8, 0), (10, -3), (5, 0)]


def page(rows=400, seed=1):
    rng = np.random.default_rng(seed)
    return np.repeat(np.repeat(rng.integers(0, 255, (rows // 2, WIDTH // 4, 3), dtype=np.uint8), 2, 0), 4, 1)


def recording(seed=1, script=SCRIPT, start=100):
    """frames (uint8, n x h x w x 3), dy per frame."""
    content = page(seed=seed)
    head, foot = np.full((HEADER, WIDTH, 3), 30, np.uint8), np.full((FOOTER, WIDTH, 3), 60, np.uint8)
    band, y, frames, steps = HEIGHT - HEADER - FOOTER, start, [], []
    for n, dy in script:
        for k in range(n):
            move = dy if frames else 0
            y += move
            steps.append(move)
            frames.append(np.concatenate([head, content[y : y + band], foot]))
    return np.stack(frames), np.array(steps)
