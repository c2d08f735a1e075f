"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published word pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 500_000


class _Pieces(dict):
    """Token counts of text pieces, each counted once; emptied when it holds too many."""

    def __init__(self, encoding, lead: str):
        super().__init__()
        self.encoding, self.lead = encoding, lead

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(self.lead + piece))
        if len(self) >= KEPT:
            self.clear()
        self[piece] = n
        return n


class Counter:
    """Counts tokens of whole texts.

    A single blank before a word always starts a new piece for this pattern, so a text without double blanks can be cut
    there and the counts of its pieces be remembered; any other text is encoded as a whole. Both give the same number.
    """

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Pieces(self.encoding, ""), _Pieces(self.encoding, " ")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text:
            return len(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        return self.first[first] + sum(map(self.rest.__getitem__, rest))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_sizes(df: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, n_tokens, n_words): one row per document.

    Rows without an id are left out, a null text has no tokens. Repeated rows count once; of rows with one id and other
    contents the one with most tokens holds. Only sizes are shuffled, never texts.
    """
    columns = ["doc_id", *keep]
    rows = df.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in keep], "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = pa.array([c.count(t) for t in texts], pa.int64())
            words = pa.array([(t.count(" ") + t.count("\n") + 1) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in columns], sizes, words], [*columns, "n_tokens", "n_words"])

    sized = rows.mapInArrow(each, ", ".join(["doc_id bigint", *[f"{c} string" for c in keep], "n_tokens bigint", "n_words bigint"]))
    most = F.max(F.struct("n_tokens", "n_words", *keep)).alias("m")
    return sized.groupBy("doc_id").agg(most).select("doc_id", *[f"m.{c}" for c in keep], "m.n_tokens", "m.n_words")
