"""Token sizes of texts under a public tokenizer, whose vocabulary file is a parameter and must lie on every worker."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the rank files' tokenizers split a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens`` and the columns ``keep``. Null and empty texts have 0 tokens; special tokens' strings are ordinary text."""

    def run(frames):
        e = encoder(vocabulary)
        for b in frames:
            sizes = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *[b.column(c) for c in keep]], names=["doc_id", "tokens", *keep])

    types = dict(documents.dtypes)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, ", ".join(["doc_id long", "tokens long", *[f"`{c}` {types[c]}" for c in keep]]))
