import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from gridloom.llm.bpe import decode, encode, load_ranks, vocabulary_path


def test_equals_tiktoken_and_decodes(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(vocabulary_path()), special_tokens={})
    texts = ["\U00010ee7a b\U00016ea7", "", None, "  \x1c x\x85y", "naïve 'll we're", "a" * 50_000, " " * 3000, "<|endoftext|>", "один два", "x y", "x y"]
    df = spark.createDataFrame([*enumerate(texts), (None, "z"), (0, "again")], "doc_id long, text string").selectExpr("*", "'own' as ids")
    rows = decode(encode(df)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "z" if r.doc_id is None else (texts[r.doc_id] or "")
        if r.decoded == "again":
            text = "again"
        ids = own.encode_ordinary(text)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), text)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode(df.limit(0)).count() == 0
