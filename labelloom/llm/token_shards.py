"""Operator 2, token-ID / binary output: shards of independent zstandard frames.

A shard file is a sequence of zstandard frames, readable by any zstandard tool:

* data frames: token ids as little-endian unsigned 32-bit integers. A frame holds whole
  documents up to ``FRAME_TOKENS`` ids; a longer document is cut over frames of its own.
* one skippable frame with the compressed document index (doc_id, ids per document).
* one skippable frame with the seek table in the public Zstandard Seekable Format: sizes of each
  data frame and the low 32 bits of the xxh64 of its content, so that a reader decompresses and
  verifies the frames of the documents it wants and no others.

Documents are in ascending doc_id order over the shards and within them: Spark range-partitions and
sorts, a task streams its range into one file. A task writes to a file name of its own attempt and
returns it as a row, so after lost executors the committed manifest names one complete file per range.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, scratch, slices, written

FRAME_TOKENS = 1 << 16
#: Bytes of pieces and ids that a Python worker remembers; characters that are encoded at once.
CACHE_BYTES, PORTION_CHARS = 16 << 20, 2 << 20
# Fixed values of the Zstandard Seekable Format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"

#: White space other than single spaces and line feeds between other characters: a text with it is split by the second pattern.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BEFORE_WORD = re.compile(r" (?=\S)")
#: A sign behind a letter at the end of a piece is a word of its own, so it becomes a piece too and the letters are one piece with and without it.
_SIGN = "([A-Za-z])([.,]\\x00)"


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer of the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    Such a tokenizer never merges across the place before a space that a non-space follows, nor around
    a line feed between non-spaces. Texts are split there by Arrow, and each distinct piece of a batch is cut into the
    tokenizer's words by its own pattern; the library's model encodes a distinct word once. The ids of a text are
    gathered from those of its pieces. Texts with other runs of white space are split only where the first rule holds.
    A text that names one of the tokenizer's added tokens, or holds the sign that pieces are split at, goes to the
    library whole. A worker remembers pieces and their ids in arrays of ``CACHE_BYTES`` at most.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        if not isinstance(tokenizer.pre_tokenizer, ByteLevel) or tokenizer.normalizer is not None or tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.tokenizer = tokenizer
        self.whole = ["\0", *(t.content for t in tokenizer.get_added_tokens_decoder().values())]
        #: How the byte-level alphabet writes each byte.
        self.letters = {b: tokenizer.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        left = iter(sorted(set(ByteLevel.alphabet()) - set(self.letters.values())))
        taken = {b: chr(b) for b in range(128, 256) if chr(b) in ByteLevel.alphabet()}
        rest = [c for c in left if c not in taken.values()]
        self.letters |= taken | dict(zip((b for b in range(128, 256) if b not in taken), rest, strict=True))
        self.model, self.words = tokenizer.model, regex.compile(public_tokenizers.PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.ids, self.starts, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _word(self, word: str) -> bytes:
        got = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(got)}I", *[t.id for t in got])

    def _piece(self, piece: str) -> bytes:
        # The usual shape, letters, needs no pattern.
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return self._word(piece)
        return b"".join(map(self._word, self.words(piece)))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of distinct pieces stands among those remembered; new ones are added."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(at.is_null())
        places = np.asarray(at.fill_null(-1)).astype(np.int64)
        places[places < 0] = len(self.pieces) + np.arange(len(new))
        own = [self._piece(x) for x in new.to_pylist()]
        sizes = np.array([len(x) // 4 for x in own], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, np.frombuffer(b"".join(own), "<u4")])
        self.pieces = pa.concat_arrays([self.pieces, new])
        return places

    @staticmethod
    def _marked(text: str) -> str:
        """The text with a NUL between its pieces."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or _ODD.search(text):
            return _BEFORE_WORD.sub("\0 ", text)
        # Each line feed becomes a piece; a space stays at the head of the word behind it.
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ")

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [any(x in t for x in self.whole) for t in texts]
        marked = pa.array(["" if w else self._marked(t) for t, w in zip(texts, whole, strict=True)], pa.large_string())
        pieces = pc.split_pattern(pc.replace_substring_regex(marked, _SIGN, "\\1\0\\2"), "\0")
        coded = pieces.flatten().dictionary_encode()
        places = self._places(coded.dictionary)[np.asarray(coded.indices)]
        per = self.sizes[places]
        ends = np.cumsum(per)
        # Each piece's ids stand one behind the other in ``ids``: the gathered place is its start and how far into it.
        out = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - (ends - per), per)]
        if self.pieces.nbytes + self.ids.nbytes + 2 * self.sizes.nbytes > CACHE_BYTES:
            self._forget()
        at = np.concatenate([[0], ends])[np.asarray(pieces.offsets)]
        return [self._whole(t) if w else out[a:b].tobytes() for t, w, a, b in zip(texts, whole, at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _whole(self, text: str) -> bytes:
        got = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(got)}I", *got)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; tasks that reuse the worker reuse what it has learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def portions(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is a range of its own."""
    start = held = 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > chars:
            yield start, k
            start, held = k, 0
        held += len(t)
    if texts:
        yield start, len(texts)


def filesystem(uri: str):
    """The pyarrow file system of a path and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


class ShardWriter:
    """Streams documents into one shard; holds one frame and 16 bytes a document."""

    def __init__(self, sink):
        self.sink, self.frames, self.ids, self.lengths = sink, [], [], []
        self.pending: list[bytes] = []
        self.held = 0
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.sink.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        if self.held and self.held + len(ids) > 4 * FRAME_TOKENS:
            self.flush()
        if len(ids) > 4 * FRAME_TOKENS:
            for k in range(0, len(ids), 4 * FRAME_TOKENS):
                self._frame(ids[k : k + 4 * FRAME_TOKENS])
        elif ids:
            self.pending.append(ids)
            self.held += len(ids)

    def close(self) -> None:
        self.flush()
        index = self.packer.compress(np.array(self.ids, dtype="<i8").tobytes() + np.array(self.lengths, dtype="<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 1 << 7, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + len(footer)) + seek + footer)


class ShardReader:
    """Reads documents of one shard by their position; decompresses the frames that hold them only."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER or not flags & (1 << 7):
            raise ValueError("not a shard: the seek table's footer is missing")
        seek_size = 12 * n + 9
        source.seek(size - seek_size - 8)
        kind, length = struct.unpack("<II", source.read(8))
        if (kind, length) != (SKIPPABLE_SEEK, seek_size):
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.frame_at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.byte_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        source.seek(int(self.frame_at[-1]))
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("broken document index")
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(length)), dtype="<i8")
        self.ids, self.lengths = np.split(index, 2)
        self.doc_at = 4 * np.concatenate([[0], np.cumsum(self.lengths)])
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.source.seek(int(self.frame_at[k]))
            content = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k}: wrong checksum")
            self.last = (k, content)
        return self.last[1]

    def tokens(self, position: int) -> bytes:
        """The ids of the document at that position of the index, as bytes."""
        a, b = int(self.doc_at[position]), int(self.doc_at[position + 1])
        if a == b:
            return b""
        k = int(np.searchsorted(self.byte_at, a, side="right")) - 1
        out = []
        while a < b:
            base = int(self.byte_at[k])
            piece = self.frame(k)[a - base : b - base]
            out.append(piece)
            a += len(piece)
            k += 1
        return b"".join(out)


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write shards under ``out``; returns the manifest, a row per shard, with ``first`` the number of ids before it.

    A null text is an empty one: its document holds the end id alone. A null doc_id sorts first. Rows with
    one doc_id are all written, ordered by text. An empty table gives an empty manifest. Columns other than
    the two named are not read. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    filesystem(out)[0].create_dir(filesystem(out)[1], recursive=True)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        path = f"{out}/shard-{shard:06d}-{uuid.uuid4().hex}.tok.zst"
        files, inner = filesystem(path)
        code, n = encoder(tokenizer), 0
        with files.open_output_stream(inner, compression=None) as sink:
            shard_file = ShardWriter(sink)
            for batch in slices(chain([first], batches), 1000):
                keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for a, b in portions(texts, PORTION_CHARS):
                    for key, ids in zip(keys[a:b], code.encode(texts[a:b]), strict=True):
                        shard_file.add(key, ids + end)
                        n += len(ids) // 4 + 1
            shard_file.close()
            size = sink.tell()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(shard_file.ids)], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(in_arrow(ordered, write, MANIFEST), "shards")
    # One row per shard: the window's single task reads no document.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("first", F.coalesce(before, F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32, path, position.

    Every frame is decompressed and verified; a task reads one shard after the other.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, inner = filesystem(row["path"])
                with files.open_input_file(inner) as source:
                    shard = ShardReader(source, row["n_bytes"])
                    starts = row["first"] + shard.doc_at // 4
                    for k in range(0, len(shard.ids), 20_000):
                        part = range(k, min(k + 20_000, len(shard.ids)))
                        ids = shard.ids[part.start : part.stop]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(ids, mask=ids == NULL_ID),
                                "start": pa.array(starts[part.start : part.stop]),
                                "n_tokens": pa.array(shard.lengths[part.start : part.stop]),
                                "ids_crc32": pa.array([zlib.crc32(shard.tokens(i)) for i in part], pa.int64()),
                                "path": pa.array([row["path"]] * len(part)),
                                "position": pa.array(np.arange(part.start, part.stop)),
                            }
                        )

    # A shard to a task where there are tasks enough; the rows are one per shard.
    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, position long")


def lookup(manifest: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Token ids of the documents named in ``wanted``: doc_id, ids. Frames without such documents stay compressed."""
    located = read_index(manifest).join(wanted.select(F.col(doc_id).alias("doc_id")).distinct().hint("merge"), "doc_id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, ShardReader] = {}
        for batch in batches:
            rows = batch.to_pylist()
            ids = []
            for row in rows:
                if row["path"] not in opened:
                    files, inner = filesystem(row["path"])
                    opened = {row["path"]: ShardReader(files.open_input_file(inner), row["n_bytes"])}
                ids.append(np.frombuffer(opened[row["path"]].tokens(row["position"]), dtype="<u4").astype(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return located.repartition("path").sortWithinPartitions("path", "position").mapInArrow(fetch, "doc_id long, ids array<long>")


def read_index(manifest: DataFrame) -> DataFrame:
    """The document indexes alone: doc_id, path, n_bytes, position."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, inner = filesystem(row["path"])
                with files.open_input_file(inner) as source:
                    ids = ShardReader(source, row["n_bytes"]).ids
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=ids == NULL_ID), "path": pa.array([row["path"]] * len(ids)), "n_bytes": pa.array([row["n_bytes"]] * len(ids), pa.int64()), "position": pa.array(np.arange(len(ids)))})

    return manifest.mapInArrow(read, "doc_id long, path string, n_bytes long, position long")


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read every one back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_shards(docs, scratch(docs.sparkSession, "tokens"), tokenizer)
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
