import random

import pytest

TOKENIZER, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


@pytest.fixture(scope="session")
def vocab():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return {name: public_tokenizers.path(name) for name in (TOKENIZER, RANKS, PIECES)}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    prose = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "zeta"]) + str(rng.randint(0, 400)) for _ in range(60))
    long = " ".join("w%d" % rng.randint(0, 3000) for _ in range(30_000))
    rows = [
        (1, prose, "x"), (2, prose.upper(), "x"), (2, prose.upper(), "x"), (3, None, None), (4, "", "y"), (None, prose, None), (None, None, None),
        (5, long, "z"), (6, "word", "z"), (7, " \t\n ", "z"), (8, prose + " tail", "z"), (9, "aé中\U0001f600 ▁b", "z"),
    ]
    return spark.createDataFrame([(*r, True, 1, "k") for r in rows], "doc_id long, text string, lang string, kept boolean, n int, ids string")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
