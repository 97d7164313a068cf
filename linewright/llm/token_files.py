"""Token ids in binary files with Elias-Fano document boundaries."""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linewright.llm.elias_fano import EliasFano, encode
from linewright.llm.registry import query, table
from linewright.llm.store import AttemptFile, held, open_input
from linewright.session import cut_lineage, fresh_path

MAGIC = b"LWTOK001"
#: At the end of a file: where its lists begin, their sizes, and the magic again.
_FOOT = "<QQQQ8s"
#: Encoded chunks and pieces of chunks that a worker keeps in one table; beyond it they are encoded again. A
#: dict of 2**20 places holds two thirds as many entries; one more would double it.
REMEMBERED = 690_000
#: Documents that are read back together.
READ_DOCS = 2048

MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_id long, n_nulls long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Lower-case Latin letters in one code point each; normalisation leaves them as they are.
_LOWER = "a-zß-öø-ÿāăąćčďđēėęěğģīįķłńņňőœŕřśşšţťūůűųźżž"
_PIECE = re.compile(f"[{_LOWER}]+|[^{_LOWER}]+")
#: Chunks of such letters, digits and ASCII punctuation other than the apostrophe.
_PLAIN = re.compile(f"[{_LOWER}!-&(-/0-9:-@\\[-`{{-~]+")
_LETTERS = re.compile(f"[{_LOWER}]+")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes a byte: as itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


class _Known(dict):
    """Values that are made when they are first asked for; a full table starts anew."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        found = self._make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = found
        return found


class CachedEncoder:
    """Ids of whole texts as little-endian bytes, each distinct chunk encoded once.

    The vocabulary drops white space before it merges anything, so a text's ids are those of
    its chunks between spaces and line ends. Without apostrophe or special token, runs of
    letters and what stands between them are pre-tokens of their own too, so such chunks are
    cut further and letters go straight to the merge model. A piece is a chunk like others, so
    both are in one table. All others go to the library as they are.
    """

    def __init__(self, file: str, dtype: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self._model = self.tokenizer.model
        self._known = _Known(self._chunk)

    def _encode(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array(self._code, ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        low = chunk.lower()
        if not _PLAIN.fullmatch(low) or "<|" in low:
            return self._encode(chunk)
        pieces = _PIECE.findall(low)
        if len(pieces) > 1 or low != chunk:
            return b"".join([self._known[p] for p in pieces])
        if not _LETTERS.fullmatch(low):
            return self._encode(low)
        spelled = low if low.isascii() else low.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
        return array(self._code, [t.id for t in self._model.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, text.replace("\n", " ").split(" ")))


def _encoder(file: str, dtype: str) -> CachedEncoder:
    return held(("encoder", file, dtype), lambda: CachedEncoder(file, dtype))


def id_type(file: str) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    return "<u2" if Tokenizer.from_file(file).get_vocab_size() <= 1 << 16 else "<u4"


def _write_shards(folder: str, file: str, dtype: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = _encoder(file, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        width = len(end)
        out, lengths, ids, nulls = None, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    out = AttemptFile(folder, f"shard-{shard:06d}", ".tok")
                    out.write(MAGIC + json.dumps({"dtype": dtype}).encode().ljust(56))
                data = encoder.encode(text.as_py() or "")
                out.write(data + end)
                lengths.append(len(data) // width + 1)
                if doc_id is None:
                    nulls += 1
                else:
                    ids.append(doc_id)
        if out is None:
            return
        ends = np.cumsum(np.array(lengths, dtype=np.int64))
        base = ids[0] if ids else 0
        at = out.position
        # Boundaries within the file: where each document ends; the first starts at 0.
        bounds, names = encode(ends), encode(np.array(ids, dtype=np.int64) - base)
        out.write(bounds)
        out.write(names)
        out.write(struct.pack(_FOOT, at, len(bounds), len(names), nulls, MAGIC))
        out.finish()
        yield pa.RecordBatch.from_pylist(
            [
                {"shard": shard, "path": out.address, "n_docs": len(lengths), "n_tokens": int(ends[-1]),
                 "first_id": base, "n_nulls": nulls}
            ],
            schema=pa.schema(
                [("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                 ("first_id", pa.int64()), ("n_nulls", pa.int64())]
            ),
        )

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1, shard_chars: int = 24_000_000
) -> DataFrame:
    """Encode every whole text and write shards in ascending ``doc_id`` order.

    Ranges of ids become partitions and each partition writes one file as it encodes, so a task
    holds the boundaries of its documents and no ids. Returns the manifest, one
    row per file with ``base``, the ids in all files before it; only files named there count.

    A file holds a 64-byte head, the ids of all its documents one after the other, the
    Elias-Fano list of document ends, the Elias-Fano list of ``doc_id`` less the first one,
    and a foot that says where the lists are. Null ids come first. Null texts are empty
    and get the end id alone. Rows with one id stand next to each other by text. An empty table
    writes no file.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, int(chars // shard_chars) + 1)
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    manifest = cut_lineage(
        ordered.mapInArrow(_write_shards(folder, tokenizer_file, id_type(tokenizer_file), end_id), MANIFEST),
        "token-manifest",
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenShard:
    """One file, read through its boundaries."""

    def __init__(self, address: str, first_id: int = 0):
        self._file = open_input(address)
        size = self._file.size()
        self._file.seek(size - struct.calcsize(_FOOT))
        at, n_bounds, n_names, self.n_nulls, magic = struct.unpack(_FOOT, self._file.read(struct.calcsize(_FOOT)))
        self._file.seek(0)
        head = self._file.read(64)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"not a token file: {address}")
        self.dtype = np.dtype(json.loads(head[8:])["dtype"])
        self._file.seek(at)
        self.ends = EliasFano(self._file.read(n_bounds))
        self.ids = EliasFano(self._file.read(n_names))
        self.first_id = first_id

    def __len__(self) -> int:
        return len(self.ends)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.get(i - 1) if i else 0), self.ends.get(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_nulls else self.first_id + self.ids.get(i - self.n_nulls)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        self._file.seek(64 + start * self.dtype.itemsize)
        return np.frombuffer(self._file.read((stop - start) * self.dtype.itemsize), self.dtype)

    def blocks(self, n: int = READ_DOCS) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """``doc_id``s and boundaries of ``n`` documents at a time."""
        for first in range(0, len(self), n):
            stop = min(first + n, len(self))
            ends = self.ends.slice(first, stop)
            start = self.ends.get(first - 1) if first else 0
            named = self.ids.slice(max(0, first - self.n_nulls), max(0, stop - self.n_nulls)) + self.first_id
            ids = [None] * max(0, min(stop, self.n_nulls) - first) + named.tolist()
            yield ids, np.concatenate([[start], ends])


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = TokenShard(row["path"], row["first_id"])
            for ids, bounds in shard.blocks():
                sums = [
                    zlib.crc32(shard.tokens(a, b).astype("<u4").tobytes())
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(bounds[:-1] + row["base"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a manifest.

    Files are dealt over the tasks; each is read block by block at the offsets that its
    boundary list gives. The checksum is over the ids in 32 bits.
    """
    files = manifest.select("path", "first_id", "base")
    return files.repartition(F.col("path")).mapInArrow(_read_shards, ROWS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, tokenizer_file: str, **settings) -> DataFrame:
    """Write the token files into the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_file, **settings))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer())
