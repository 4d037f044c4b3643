import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from encore.llm.token_counts import Counter, count_tokens, load_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = [*"ab XY'sdt12²½Ⅷéßñ日本語한\n\t\x1c\x1d\x85\xa0 ​　́🙂.,!-_\x00\x7f",
        "<|endoftext|>", "'ll", "'re", "  ", " \n ", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_like_the_library(library):
    counter, draw = Counter(load_vocabulary(PATH)), random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(POOL) for _ in range(draw.randint(0, 40)))
        assert counter.text(text) == expected(library, text), repr(text)


def test_long_pieces(library):
    counter = Counter(load_vocabulary(PATH))
    for text in ("a" * 20_000, "abc" * 9_000, "the " * 9_000, " " * 9_000):
        assert counter.text(text) == expected(library, text)


def test_rows(spark, library):
    texts = [None, "", "plain words, here", "plain words, here", "x" * 3000, "a<|endoftext|>b"]
    rows = [(i if i != 2 else None, t, "en", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, over_limit int")
    found = [tuple(r) for r in count_tokens(docs, PATH).collect()]
    wanted = [
        (r[0], len((r[1] or "").encode()), n := expected(library, r[1]), n > 512) for r in rows
    ]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert count_tokens(docs.limit(0), PATH).count() == 0
