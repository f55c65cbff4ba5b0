import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, kept string, keep_id long, text_sha256 double, _row_hash int, `a.b` string"


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): copies, near copies, shared passages, nulls, empties, repeated rows, a long text."""
    rng = random.Random(7)
    words = ["the", "of", "Éa", "über", "x1", "b", "c,", "D.", "e", "f", "g", "h"]
    passages = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(30, 90))) for _ in range(6)]
    out = []
    for k in range(120):
        text = rng.choice([" ", "\n", " \t "]).join(rng.choice(words) for _ in range(rng.randint(0, 50)))
        if k % 3 == 0:
            text += "\n" + rng.choice(passages) + " " + rng.choice(words)
        out.append((k, text))
    out += [(200 + k, t.upper() if k % 2 else t) for k, (_, t) in enumerate(out[:30])]
    out += [(300 + k, t + " end") for k, (_, t) in enumerate(out[60:80])]
    out += [(400, None), (401, ""), (402, "  \n "), (403, "one"), (403, "one"), (404, "One two"), (None, "a lost row"), (None, "one")]
    out += [(500, " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(20_000)))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with extra columns of clashing names."""
    return spark.createDataFrame([(d, t, f"k{d}", 1, 0.5, 7, None) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
