import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chainspark.llm.tokens import BytePairCounter, count_tokens
from tests.llm import plain

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbéÉΣσß½²٣İıﬀ中文́\u0085\x1c\x1f​ 　 \t\n'sStTreveLL!#$--...aaaa0123ab è한글가🙂👍🏽ก\x00"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_library_s(library):
    rng = random.Random(11)
    texts = []
    for k in range(4000):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))
        if k % 7 == 0:
            s += "<|endoftext|>" + s + "<|startoftext|"
        if k % 50 == 0:
            s += rng.choice("!#a-") * rng.randint(1, 300)
        texts.append(s)
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert BytePairCounter(PATH).counts(texts) == want


def test_table_and_odd_rows(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    for r in count_tokens(docs, PATH).collect():
        t = texts[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)
    odd = plain.odd_documents(spark)
    got = sorted((r["doc_id"] or 0, r["n_bytes"]) for r in count_tokens(odd, PATH).collect())
    assert got == sorted((r["doc_id"] or 0, len((r["text"] or "").encode())) for r in odd.collect())
    assert count_tokens(plain.empty_documents(spark), PATH).count() == 0
