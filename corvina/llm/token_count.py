"""Token counts of a sentencepiece BPE model by a whole-token shortcut.

Offline, from the model file alone:
- No piece of such a vocabulary holds a space mark after another character (checked when the file is loaded), so no merge crosses from a word into the space before the next one: the pieces of a text are those of its segments, spaces followed by other characters, one after the other.
- Every vocabulary string is encoded alone; those that come out as one token form the set of whole tokens.

A segment in that set counts as one token directly; only the rest are merged, each distinct one once for as long as it stays in a bounded table of the worker. No shuffle.

Defined cases: a null text is empty: 0 bytes, 0 tokens; null and repeated doc_ids are kept row for row; other columns are ignored; an empty table gives an empty result. Models with a normalization table, or with pieces that hold a space mark after another character, are refused.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table

LIMIT = 4096
#: Distinct merged segments that a worker remembers.
REMEMBERED = 300_000
_MARK = "▁"
_SEGMENTS = re.compile(" +[^ ▁]*|[^ ▁]+")


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """A function from a text to its number of tokens."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    normal = [p.piece for p in model.pieces if p.type == 1]
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.model_type != 2:
        raise ValueError("not a plain BPE model with a dummy prefix")
    if any(p.type in (4, 5) for p in model.pieces) or any(_MARK in p.lstrip(_MARK) for p in normal):
        raise ValueError("its pieces are not bounded by spaces")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    # A piece that begins with a space mark can stand as a whole segment; the library puts the first space itself.
    led = [p for p in normal if p.startswith(_MARK)]
    whole = {p.replace(_MARK, " "): 1 for p, ids in zip(led, sp.encode([p[1:].replace(_MARK, " ") for p in led], num_threads=1), strict=True) if len(ids) == 1}
    # a single space at the end has nothing to merge with: its piece, or its bytes
    whole[" "] = 1 if _MARK in normal else len(_MARK.encode())
    known = dict(whole)

    def count(text: str) -> int:
        if not text:
            return 0
        if _MARK in text or "\0" in text:
            return len(sp.encode(text))
        segments = _SEGMENTS.findall(" " + text)
        try:
            return sum(map(known.__getitem__, segments))
        except KeyError:
            pass
        rest = list({s for s in segments if s not in known})
        if len(known) + len(rest) > len(whole) + REMEMBERED:
            known.clear()
            known.update(whole)
            rest = list({s for s in segments if s not in known})
        for s, ids in zip(rest, sp.encode([s[1:] for s in rest], num_threads=1), strict=True):
            known[s] = len(ids)
        return sum(map(known.__getitem__, segments))

    return count


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of docs(doc_id, text)."""

    def run(batches):
        count = counter(path)
        for (ids,), data, offsets in slices(batches, ["doc_id"]):
            raw, bounds = data.tobytes(), offsets.tolist()
            n = [count(raw[a:b].decode()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
