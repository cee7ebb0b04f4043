"""Sizes of texts in tokens of a public byte-level BPE vocabulary; nothing is trained here."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: A rank file with one "base64(token) rank" a line. It is read on the driver (under 1 MB) and sent to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Ids are below this number (256 bytes and the merges); it bounds every table by token id.
MOST_IDS = 100_000
#: The split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer segment is encoded in blocks of about so many characters, cut where the split pattern cuts it as well.
BLOCK = 20_000


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


#: Segments end with a run of these marks before a blank, letter or digit: there the split pattern always cuts as well, as
#: its matches of marks hold nothing else.
_MARKS = "，。；：、！？.,;:!?"
_SEGMENT = re.compile(rf"(?s)(?:[^{_MARKS}]*+[{_MARKS}]++)+?(?=\s|[^\W_])|.+")
#: So many segments are remembered with their tokens by a worker; then it begins anew.
REMEMBERED = 100_000

_made: dict[int, Callable[[str], np.ndarray]] = {}
_SPLIT = regex.compile(PATTERN)


def _blocks(s: str) -> Iterator[tuple[str, bool]]:
    """s in blocks that end where the split pattern ends a match, so that each is encoded as it would be within s; and
    whether a block is a single match. A match longer than BLOCK is a block of its own."""
    start = end = 0
    for m in _SPLIT.finditer(s):
        if m.end() - m.start() > BLOCK:
            if end > start:
                yield s[start:end], False
            yield m[0], True
            start = m.end()
        elif m.end() - start > BLOCK:
            yield s[start:end], False
            start = m.start()
        end = m.end()
    if end > start:
        yield s[start:end], False


def encoder(raw: bytes) -> Callable[[str], np.ndarray]:
    """text -> token ids. Segments met before are looked up; a long one is split by the pattern here, as the pattern
    engine of the tokenizer has a stack of bounded depth, and encoded block by block with the same result."""
    if (key := hash(raw)) not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        if len(ranks) > MOST_IDS:
            raise ValueError(f"a vocabulary of more than {MOST_IDS} tokens")
        whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        one = whole.encode_ordinary
        known: dict[str, bytes] = {}

        def look(s: str) -> bytes:
            if len(s) > BLOCK:
                return b"".join(np.array(whole._encode_single_piece(b) if single else one(b), dtype=np.int32).tobytes() for b, single in _blocks(s))
            ids = np.array(one(s), dtype=np.int32).tobytes()
            if len(s) <= 400:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[s] = ids
            return ids

        def encode(text: str) -> np.ndarray:
            return np.frombuffer(b"".join([got if (got := known.get(s)) is not None else look(s) for s in _SEGMENT.findall(text)]), np.int32)

        _made[key] = encode
    return _made[key]


def sized(documents: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, keep..., n_tokens): a null or empty text has 0 tokens."""
    raw = vocabulary(documents.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(raw.value)
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=["doc_id", *keep, "n_tokens"])

    src = documents.select("doc_id", *keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(count, f"{kinds}, n_tokens bigint")
