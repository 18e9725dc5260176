"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

Every byte maps to one code point, so each vocabulary entry is a piece; a piece's score is its
negative rank and normalisation is the identity, so that sentencepiece merges the pair of lowest
rank first, leftmost on ties. Pre-tokens are encoded separately; one that is an entry itself is
that entry. Decoding maps ids back to bytes.

Null texts are empty and have no ids. Equal texts get equal results; an empty table gives none. A
text is encoded whole, however long; a worker holds the slice of texts at hand and KEPT_BYTES of
known pre-tokens at most. Two pairs of one rank in a pre-token are merged from the left.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as spm

from gridspark.llm.common import chunks, pieces

#: Code point of byte 0; all 256 are letters without case, marks or forms of normalisation.
FIRST = 0x4E00
#: Bytes of pre-tokens kept with their ids in one worker, beside those of the text at hand; each counts ENTRY more for its objects.
KEPT_BYTES, ENTRY = 64_000_000, 250
#: Ids decoded at once.
CHUNK_IDS = 500_000


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


_MAP = {b: chr(FIRST + b) for b in range(256)}


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose id is the rank plus one; id 0 is the unknown piece, which never occurs."""
    model = spm.ModelProto()
    model.trainer_spec.model_type = spm.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(ranks) + 1
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    spec = model.normalizer_spec
    spec.name = "identity"
    spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0, type=spm.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=mapped(token), score=-rank, type=spm.ModelProto.SentencePiece.NORMAL)
    return model.SerializeToString()


def narrow(pattern: str) -> re.Pattern:
    """The pattern for texts of code points below 256, with its Unicode classes written out; the same matches, faster."""
    few = "".join(map(chr, range(256)))
    spell = lambda c: "".join(re.escape(x) for x in regex.findall(c, few))
    out, inside = "", False
    for m in regex.finditer(r"\\[pP]\{\w+\}|\\.|.", pattern, regex.S):
        x = m[0]
        if x[:2] in (r"\p", r"\P", r"\s", r"\S", r"\d", r"\D", r"\w", r"\W"):
            out += spell(x) if inside else f"[{spell(x)}]"
        else:
            inside = x == "[" or inside and x != "]"
            out += x
    return re.compile(out)


class Codec:
    """Encodes and decodes texts by one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must run from 0 without a gap")
        token = sorted(self.ranks, key=self.ranks.get)
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.size = np.array([len(x) for x in token])
        self.start = np.cumsum(self.size) - self.size
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.find, self.find_narrow = regex.compile(pattern).findall, narrow(pattern).findall
        self.kept: dict[str, str] = {}
        self.kept_bytes = 0

    def learn(self, new: list[str]) -> None:
        """Keep the ids of pre-tokens, each followed by a comma."""
        rest = []
        for x in new:
            rank = self.ranks.get(x.encode())
            if rank is None:
                rest.append(x)
            else:
                self.kept[x] = f"{rank},"
        got = self.model.encode([mapped(x.encode()) for x in rest], num_threads=1) if rest else []
        for x, ids in zip(rest, got, strict=True):
            self.kept[x] = "".join([f"{i - 1}," for i in ids])
        self.kept_bytes += sum(len(x) + len(self.kept[x]) + ENTRY for x in new)

    def written(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        try:
            text.encode("latin-1")
            pre = self.find_narrow(text)
        except UnicodeEncodeError:
            pre = self.find(text)
        kept = self.kept
        if new := [x for x in set(pre) if x not in kept]:
            if self.kept_bytes > KEPT_BYTES:
                kept.clear()
                self.kept_bytes = 0
                new = list(set(pre))
            self.learn(new)
        return "".join([kept[x] for x in pre])[:-1]

    def encode(self, text: str) -> np.ndarray:
        return ids_of(self.written(text))

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


def ids_of(written: str) -> np.ndarray:
    return np.fromstring(written, np.int32, sep=",") if written else np.zeros(0, np.int32)


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for rows, texts in chunks(batch):
                out = []
                for x in texts:
                    written = c.written((x or b"").decode())
                    ids = ids_of(written)
                    out.append((len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                n, a, b = map(list, zip(*out, strict=True)) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    """Lists of ids as one Arrow array, without a Python object for each id."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def beside(docs: DataFrame, without: tuple[str, ...], column: str) -> tuple[DataFrame, list[str]]:
    """`column` of docs and, as one struct `row`, all columns but `without`, with their names."""
    names = [c for c in docs.columns if c not in without]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), column), names


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs with `ids` array<int> after them (in place of a column ids that docs has); a null text has no ids."""
    rows, names = beside(docs, ("ids",), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("row"), id_lists([c.encode((x or b"").decode()) for x in texts])], names=["row", "ids"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "ids")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens (ids array<int>) with `bytes` binary, what the ids stand for, in place of ids; no ids stand for no bytes."""
    rows, names = beside(tokens, ("ids", "bytes"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            for at, to in pieces(sizes, CHUNK_IDS):
                ids = batch.column("ids").slice(at, to - at).flatten().to_numpy()
                ends = np.cumsum(np.append(0, c.size[ids]))[np.cumsum(np.append(0, sizes[at:to]))]
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(c.decode(ids))])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, to - at), data.cast(pa.binary())], names=["row", "bytes"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("bytes", T.BinaryType())]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "bytes")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, n_tokens, ids, round_trip: each text encoded, and whether its ids decode to it, in one pass over docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for rows, texts in chunks(batch):
                ids = [c.encode((x or b"").decode()) for x in texts]
                same = [c.decode(x) == (t or b"") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array([len(x) for x in ids], pa.int64()), id_lists(ids), pa.array(same, pa.bool_())], names=["doc_id", "text", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_tokens long, ids array<int>, round_trip boolean")
