import random

import pytest

WORDS = "river stone cloud amber quiet field lantern marble copper willow harbor meadow thunder velvet garden winter".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, visits string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", ","]) for _ in range(n))


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies; an extra column with a taken name."""
    base = prose(1, 80)
    near = base.replace("river", "rivers", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n "), (7, "One two"), (8, "one TWO"),
        (9, prose(2, 6000)), (None, base + " tail of it"), (1, base), (10, f"{prose(3, 40)} {base[:200]} {prose(4, 40)}"),
        (11, "été " * 30 + "ß" * 60), (12, "x" * 500), (13, prose(5, 30)), (14, prose(5, 30) + " end"),
    ]
    return [(i, t, "en", None if i == 13 else f"src{(i or 0) % 3}", None if t is None else len(t), "extra") for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return prose
