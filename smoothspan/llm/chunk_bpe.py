"""Byte-level BPE by reuse of content-defined chunks.

A rolling hash over the bytes before a white-space byte decides where a text is cut, so equal passages are cut alike in
every document. Each distinct chunk of an Arrow batch is encoded once (and kept in a bounded cache for the later batches of
the task); the ids of a document are put together from its chunks.

A join is sound where the pre-tokenizer provably ends a piece: between a character that is no white space and white space
after it. Any other join (runs of white space, characters that may be Unicode white space) is doubtful and is repaired: the
bytes between the sound places next to it, on both sides, are encoded again, and their ids replace those that the chunks gave
for these bytes. If the ids of a chunk don't end at such a place, the chunks around the join are encoded as one. So the ids
agree with those of the uncut text; ``verify_joins`` compares them and is what the tests run.

The exchange of chunks between machines is left out on purpose: it would shuffle each text and its ids once more, which is
more than encoding costs. Reuse is within a task, and memory is bounded by the batch and the cache.

Defined results: a null text counts as empty and has no ids; very long texts are encoded whole; ties between merges are those of
the file's ranks; special-token strings are encoded as the tokenizer encodes them;
columns other than the id and text columns are ignored; repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothspan.llm import workers
from smoothspan.llm.bytescan import blocks, text_buffers
from smoothspan.llm.workers import returning_memory

#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class ChunkSettings:
    """``window``: bytes under the rolling hash. ``mask_bits``: a cut for one of 2**mask_bits places, 0 cuts at all of them.
    ``cache_bytes``: most text that a worker keeps encoded between batches."""

    window: int = 4
    mask_bits: int = 4
    cache_bytes: int = 2 << 20


def cut_places(raw: np.ndarray, offsets: np.ndarray, settings: ChunkSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where chunks start (every row start and every content-defined cut), whether the join there is doubtful,
    and all sound places, cut or not, with the row starts."""
    at = np.flatnonzero(_WHITE[raw])
    at = at[at > 0]
    before = raw[at - 1]
    lead = raw[np.maximum(at - 2, 0)]
    # ASCII that is neither white space nor a control, or a two-byte character from U+00C0 on: never white space.
    safe = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead <= 0xDF))
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    sound = np.zeros(len(raw), dtype=bool)
    sound[at[safe]] = True
    sound[rows] = True
    starts = np.zeros(len(raw), dtype=bool)
    if settings.mask_bits:
        rolled = np.zeros(len(at), dtype=np.uint32)
        with np.errstate(over="ignore"):
            for k in range(1, settings.window + 1):
                rolled = rolled * np.uint32(0x01000193) + raw[np.maximum(at - k, 0)].astype(np.uint32)
            rolled ^= rolled >> np.uint32(15)
        at = at[(rolled & np.uint32((1 << settings.mask_bits) - 1)) == 0]
    starts[at] = True
    starts[rows] = True
    places = np.flatnonzero(starts)
    return places, ~sound[places], np.flatnonzero(sound)


class ChunkEncoder:
    """Encodes Arrow string columns with the tokenizer file at ``path``."""

    def __init__(self, path: str, settings: ChunkSettings = ChunkSettings()):
        from tokenizers import Tokenizer

        self.settings = settings
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, tuple[bytes, bytes, int]] = {}
        self.cached = 0
        alphabet = _byte_alphabet()
        self.piece: dict[int, bytes] = {}
        self.text: dict[int, str] = {}
        added = {i for i in self.tokenizer.get_added_tokens_decoder()}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.piece[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
            self.text[i] = str(i)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(json.loads(self.tokenizer.to_str()), added)

    def _ranked(self, file: dict, added: set[int]):
        """The same merges as ranks in a faster library, or None where ids don't follow the order of the merges."""
        model, split = file["model"], file["pre_tokenizer"]
        if split is None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or file["normalizer"]:
            return None
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab["".join(p)] for p in pairs]
        if any(a >= b for a, b in zip(made, made[1:])):
            return None
        import tiktoken

        ranks = {self.piece[i]: i for i in vocab.values() if i not in added}
        return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = list(map(self.ranked._core_bpe.encode_ordinary, texts))
        joined = "\n".join(texts)
        for x in self.special:
            if x in joined:
                for k, t in enumerate(texts):
                    if x in t:
                        ids[k] = self.tokenizer.encode(t, add_special_tokens=False).ids
        return ids

    def chunks(self, texts: list[str]) -> list[tuple[bytes, bytes, int]]:
        """(ids joined by commas, decoded bytes, number of ids) of each chunk."""
        cache = self.cache
        missing = [t for t in texts if t not in cache]
        if missing:
            gc.disable()  # only tuples of bytes are made, which hold no cycles
            if self.cached > self.settings.cache_bytes:
                keep = set(texts)
                for key in [k for k in cache if k not in keep]:
                    del cache[key]
                self.cached = sum(map(len, cache))
            piece, text = self.piece, self.text
            for k in range(0, len(missing), 4096):
                part = missing[k : k + 4096]
                for t, ids in zip(part, self._ids(part), strict=True):
                    cache[t] = (",".join([text[i] for i in ids]).encode(), b"".join([piece[i] for i in ids]), len(ids))
                    self.cached += len(t)
            gc.enable()
        return [cache[t] for t in texts]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, list[bytes], list[bytes], np.ndarray]]:
        """(first row, ids text, decoded bytes, number of ids) for runs of rows."""
        raw, offsets = text_buffers(column)
        for first, rows, part, at in blocks(raw, offsets):
            places, doubtful, sound = cut_places(part, at, self.settings)
            if not len(places):
                yield first, [b""] * rows, [b""] * rows, np.zeros(rows, np.int64)
                continue
            bounds = pa.py_buffer(np.append(places, len(part)).astype(np.int32))
            chunk = pa.Array.from_buffers(pa.string(), len(places), [None, bounds, pa.py_buffer(np.ascontiguousarray(part))])
            coded = chunk.dictionary_encode()
            found = self.chunks(coded.dictionary.to_pylist())
            index = coded.indices
            if doubtful.any():
                index = index.to_numpy().copy()
                heads = np.flatnonzero(~doubtful)
                ends = np.append(heads[1:], len(places))
                many = ends - heads > 1
                found += self._repaired(part.tobytes(), np.append(places, len(part)), sound, list(zip(heads[many].tolist(), ends[many].tolist())), [found[i] for i in index.tolist()])
                index[heads[many]] = np.arange(len(found) - many.sum(), len(found))
                index, places = pa.array(index[heads]), places[heads]
            per_row = pa.array(np.searchsorted(places, at).astype(np.int32))
            ids = pc.binary_join(pa.ListArray.from_arrays(per_row, pa.array([x[0] for x in found], pa.binary()).take(index)), b",")
            back = pc.binary_join(pa.ListArray.from_arrays(per_row, pa.array([x[1] for x in found], pa.binary()).take(index)), b"")
            counts = np.append(0, np.cumsum(np.array([x[2] for x in found], dtype=np.int64)[index.to_numpy()]))
            spans = per_row.to_numpy()
            yield first, ids.to_pylist(), back.to_pylist(), counts[spans[1:]] - counts[spans[:-1]]

    def _repaired(self, data: bytes, bounds: np.ndarray, sound: np.ndarray, runs: list[tuple[int, int]], found: list[tuple[bytes, bytes, int]]) -> list[tuple[bytes, bytes, int]]:
        """One entry for each run (first chunk, chunk after the last) of chunks with doubtful joins between them.

        ``bounds``: where chunks start, and the end; ``found``: the entries of the chunks as they were cut."""
        joins = np.concatenate([bounds[a + 1 : b] for a, b in runs])
        last = np.repeat(bounds[[b for _, b in runs]], [b - a - 1 for a, b in runs])
        right = np.searchsorted(sound, joins)
        low = sound[right - 1].tolist()
        high = np.minimum(np.append(sound, len(data))[right], last).tolist()
        window = dict(zip(zip(low, high), self.chunks([data[x:y].decode() for x, y in zip(low, high)])))
        spans, out, bounds = list(zip(low, high)), [], bounds.tolist()
        done = 0
        for a, b in runs:
            mine = list(dict.fromkeys(spans[done : done + b - a - 1]))
            done += b - a - 1
            ids, back, sure = [], [], True
            todo = iter([*mine, (bounds[b], bounds[b])])
            x, y = next(todo)
            # The chunks' own ids, but for those inside a window, whose ids come from the window.
            for k in range(a, b):
                at = bounds[k]
                for i in found[k][0].split(b",") if found[k][2] else ():
                    end = at + len(self.piece[int(i)])
                    while at >= y and y < bounds[b]:
                        x, y = next(todo)
                    if end <= x:
                        ids.append(i)
                        back.append(self.piece[int(i)])
                    elif at < x:
                        sure = False
                    else:
                        if at == x:
                            ids.append(window[x, y][0])
                            back.append(window[x, y][1])
                        sure = sure and end <= y
                    at = end
                sure = sure and at == bounds[k + 1]
            if sure:
                ids = b",".join(ids)
                out.append((ids, b"".join(back), ids.count(b",") + 1))
            else:
                out.extend(self.chunks([data[bounds[a] : bounds[b]].decode()]))
        return out

    def clear(self) -> None:
        self.cache, self.cached = {}, 0

    def verify_joins(self, text: str) -> bool:
        """Whether the ids put together from chunks are those of the whole text."""
        whole = self.tokenizer.encode(text, add_special_tokens=False).ids
        _, ids, _, _ = next(self.encode(pa.array([text])))
        return ids[0].decode() == ",".join(map(str, whole))


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


def decode_bytes(data: bytes) -> str:
    """What the byte-level decoder makes of the bytes of all ids."""
    return data.decode("utf-8", errors="replace")


def worker_encoder(path: str, settings: ChunkSettings) -> ChunkEncoder:
    """One encoder for each Python worker; its chunks are given up at the end of a task, and it itself when the worker gets a
    task of another operator."""
    key = (path, settings)
    if workers.held.get(__name__, (None,))[0] != key:
        workers.held[__name__] = (key, ChunkEncoder(path, settings))
    return workers.held[__name__][1]


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", settings: ChunkSettings = ChunkSettings()
) -> DataFrame:
    """Ids and decoded text of every document: (id, ids array<int>, decoded string)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, settings)
        for batch in batches:
            for first, ids, back, _ in encoder.encode(batch.column(1)):
                lists = [[int(i) for i in x.split(b",")] if x else [] for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ids)), pa.array(lists, pa.list_(pa.int32())), pa.array([decode_bytes(b) for b in back])],
                    names=[id_col, "ids", "decoded"],
                )
        encoder.clear()

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded string")


def digest_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", settings: ChunkSettings = ChunkSettings()
) -> DataFrame:
    """The digests of :func:`encode_documents`' results, taken where the ids are made: (id, n_tokens, ids_sha256, decoded_sha256)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, settings)
        for batch in batches:
            for first, ids, back, counts in encoder.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(ids)),
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(decode_bytes(b).encode()).hexdigest() for b in back]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        encoder.clear()

    return docs.select(id_col, F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
