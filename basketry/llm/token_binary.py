"""Token ids as Arrow IPC files of fixed-size sequences.

Documents are range-partitioned by ``doc_id``; each task tokenises its own run, packs the
ids of consecutive documents into sequences of one length and streams them, batch by batch,
into a shard: an Arrow IPC file with two fixed-size-list columns, ``tokens`` (the smallest
unsigned type that holds the vocabulary) and ``mask`` (a byte a place, 0 in the padding of the
last sequence; dictionary-encoded, as all sequences but the last share one), beside a small
file that tells where each document starts. A fixed length makes
a position's batch, row and offset plain arithmetic, so :class:`Shard` reads any range
without decoding what lies before it, and ids and mask without copying where the file is mapped.

A vocabulary's added tokens (``<|endoftext|>``) become their ids where a text spells them out,
as the tokenizers library does by itself; ``specials_as_text`` leaves them ordinary text, as its
``encode_special_tokens`` does.

A task writes under a name of its own and only the manifest of finished tasks names files,
so a retried or speculative task never mixes into the result.

Defined cases: a null text is empty (its only id is the end id); equal or null ``doc_id``
values are ordered by text, nulls first; an empty table gives no shards; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.splitting import splitter
from basketry.llm.workspace import new_path, small_batches, written

#: Pre-tokens remembered by a Python worker before it starts afresh.
MEMO = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of whole texts from the tokenizers library, as unsigned 32-bit bytes.

    A byte-level BPE vocabulary encodes each match of its splitting pattern by itself. So a text is split by the pattern,
    the library's model encodes each distinct match, and its ids are repeated wherever it occurs. A text that spells
    out an added token is encoded whole by the library.
    """

    def __init__(self, tokenizer_file: str, pattern: str, specials_as_text: bool = False):
        from tokenizers import Tokenizer

        self.whole = tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.encode_special_tokens = specials_as_text
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not (specials_as_text and t.special)]
        self.size, self.model = tokenizer.get_vocab_size(), tokenizer.model
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        self.split = splitter(pattern)
        self.memo: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            spelt = piece
        elif piece[0] == " " and piece[1:].isalpha() and piece.isascii():
            spelt = self.space + piece[1:]
        else:
            spelt = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        memo, out = self.memo, []
        for p in self.split(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[p] = self._piece(p)
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def piece_encoder(tokenizer_file: str, pattern: str, specials_as_text: bool = False) -> PieceEncoder:
    """One for a Python worker, however many tasks it runs."""
    return PieceEncoder(tokenizer_file, pattern, specials_as_text)


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 2**16 else pa.uint32()


def _create(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(inner)


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)


class ShardWriter:
    """Streams ids into sequences of ``length``, ``rows`` sequences a record batch."""

    def __init__(self, path: str, length: int, dtype: pa.DataType, rows: int = 64):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = pa.schema([("tokens", pa.list_(dtype, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        self.file = _create(path)
        self.out = pa.ipc.new_file(self.file, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype.to_pandas_dtype()))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= (most := self.length * self.rows):
            flat = np.concatenate(self.held)
            while len(flat) >= most:
                self._batch(flat[:most], most)
                flat = flat[most:]
            self.held, self.n_held = [flat], len(flat)

    def _batch(self, flat: np.ndarray, n: int) -> None:
        full, rest = divmod(n, self.length)
        masks = np.ones((1 + (rest > 0), self.length), np.uint8)  # of full sequences, and of a last one that is not
        masks[1:, rest:] = 0
        which = np.repeat(np.arange(2, dtype=np.int8), (full, rest > 0))
        mask = pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel()), self.length))
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), mask], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype.to_pandas_dtype())
        if n := len(flat):
            self._batch(np.concatenate((flat, np.zeros(-n % self.length, flat.dtype))), n)
        self.out.close()
        self.file.close()


class Shard:
    """Random access to a shard by position."""

    def __init__(self, path: str, rows: int = 64):
        self.reader = pa.ipc.open_file(_open(path))
        self.length, self.rows = self.reader.schema.field("tokens").type.list_size, rows
        self.at, self.batch = -1, None

    def _load(self, k: int):
        if k != self.at:
            self.at, self.batch = k, self.reader.get_batch(k)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, views of the file."""
        batch, row = self._load(i // self.rows), i % self.rows
        ids, mask = batch.column(0), batch.column(1)
        spans = (ids.flatten(), row), (mask.dictionary.flatten(), mask.indices[row].as_py())
        return tuple(flat.slice(k * self.length, self.length).to_numpy() for flat, k in spans)

    def tokens(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from position ``first``."""
        span, parts = self.length * self.rows, []
        while n:
            k, lo = divmod(first, span)
            take = min(n, span - lo)
            parts.append(self._load(k).column(0).flatten().slice(lo, take).to_numpy())
            first, n = first + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_shards(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int, length: int = 1024, shards: int | None = None, specials_as_text: bool = False) -> DataFrame:
    """Write the shards; the manifest: shard (ascending with doc_id), tokens_path, docs_path, n_docs, n_tokens, start (ids before the shard)."""
    spark = docs.sparkSession
    small_batches(spark)
    base = new_path(spark, "token-shards")
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, first = piece_encoder(tokenizer_file, pattern, specials_as_text), None, 0
        shard, index = TaskContext.get().partitionId(), []
        name = f"{base}/{shard:06d}-{uuid.uuid4().hex}"
        dtype = id_type(max(encoder.size, end_id + 1))
        schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
        docs_out = None
        n_docs = 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                if out is None:
                    out, docs_file = ShardWriter(f"{name}.tokens.arrow", length, dtype), _create(f"{name}.docs.arrow")
                    docs_out = pa.ipc.new_file(docs_file, schema)
                index = []
                for text in part.column(1):
                    ids = np.append(np.frombuffer(encoder.encode(text.as_py()), np.uint32), np.uint32(end_id))
                    out.add(ids)
                    index.append((first, len(ids)))
                    first += len(ids)
                n_docs += len(index)
                docs_out.write_batch(pa.record_batch([part.column(0), pa.array([x[0] for x in index], pa.int64()), pa.array([x[1] for x in index], pa.int64())], schema=schema))
        if out is not None:
            out.close()
            docs_out.close()
            docs_file.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "tokens_path": [f"{name}.tokens.arrow"], "docs_path": [f"{name}.docs.arrow"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([first], pa.int64())})

    manifest = written(ordered.mapInArrow(run, "shard int, tokens_path string, docs_path string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard, docs = Shard(row["tokens_path"]), pa.ipc.open_file(_open(row["docs_path"]))
                for k in range(docs.num_record_batches):
                    d = docs.get_batch(k)
                    spans = list(zip(d.column(1).to_pylist(), d.column(2).to_pylist(), strict=True))
                    crc = [zlib.crc32(shard.tokens(first, n).astype("<u4").tobytes()) for first, n in spans]
                    yield pa.RecordBatch.from_pydict({"doc_id": d.column(0), "start": pa.array([row["start"] + first for first, _ in spans], pa.int64()), "n_tokens": d.column(2), "ids_crc32": pa.array(crc, pa.int64())})

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(manifest.select("shard", "tokens_path", "docs_path", "start"), "token-starts").repartition(parts, "shard")
    return dealt.select("tokens_path", "docs_path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
