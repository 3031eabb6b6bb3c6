import random
import zlib

import numpy as np

from pairwell.llm import language, linear


def trains(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def test_every_label_is_learnt(make_docs):
    """More labels than 200, one of them with a single training row."""
    rng, rows, names = random.Random(9), [], [f"l{k:03}" for k in range(230)]
    ids = iter(range(100_000))
    for k, name in enumerate(names):
        letters = [chr(0x4E00 + 6 * k + j) for j in range(6)]
        for _ in range(1 if k == 229 else 3):
            rows.append((next(i for i in ids if trains(i)), "".join(rng.choices(letters, k=60)), name))
    docs = make_docs(rows)
    model = language.train(docs)
    assert model.languages == names
    assert [model.predict(t)[0] for _, t, _ in rows] == [name for _, _, name in rows]


def test_calibration_rows_come_from_labels_with_enough():
    labels = [0] * 50 + [1] * 9 + [2] * 10
    held = linear.calibration_rows(labels)
    assert [int(held[np.array(labels) == k].sum()) for k in range(3)] == [10, 0, 2]
    assert linear.calibration_rows(labels, most=4).sum() == 2 and not linear.calibration_rows([]).any()
