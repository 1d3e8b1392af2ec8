"""Token ids of whole texts, and a binary file format for them.

**Ids.** A text is encoded by the ``tokenizers`` library. Byte-level BPE never merges over the borders its own splitter draws, so
equal words always give equal ids: words are encoded once per worker and then looked up. Plain texts (words
parted by single spaces or line feeds) are cut by ``str.split``; all others go to the library whole.

**Files.** One file per shard of the document order, made of:

    magic, version                  8 bytes
    frames                          per document: its ids (little-endian, 16 bits if the vocabulary fits, else 32), compressed
                                    by themselves with the shared zstandard dictionary
    index                           per document: offset and size of its frame, number of ids, id, whether the id is null
    tail                            index position, number of documents, bytes per id, SHA-256 of the dictionary, magic

A short document is read by one seek into the index and one into the frames. The dictionary is a file of its own, named by its hash,
trained on the id arrays of a bounded sample of documents; it only affects sizes. Shards are written under a temporary name and
renamed, so a task that is run again replaces its shard by an equal one.

Edge cases: null text is empty and holds the end id only; documents with a null doc_id come first; repeated doc_ids stay apart, in the
order of their frames; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import gc
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import materialize, scratch_path

END_ID = 2
MAGIC = b"TIDEIDS1"
TAIL = struct.Struct("<qqq32s8s")
INDEX = np.dtype([("offset", "<i8"), ("size", "<i4"), ("n", "<i4"), ("doc_id", "<i8"), ("null", "u1")])
#: Bounds of the dictionary's training set: documents, and ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 4096, 64 << 10
#: Words remembered by one table of a worker; a full table starts anew.
REMEMBERED = 1_000_000


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """word -> the bytes of its ids, found once; starts anew when it is full."""

    def __init__(self, find, lead: str = ""):
        self.find, self.lead = find, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = self.find(self.lead + word)
        return out


class Encoder:
    """``ids(text)``: the library's ids as an array, through tables of words."""

    def __init__(self, path: str):
        import os

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the library's own splitter, and the characters its model writes for bytes
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [i for i in range(256) if i not in own]
        self.letters = {i: i for i in own} | {b: 256 + k for k, b in enumerate(rest)}
        self.codes = [x.tobytes() for x in np.arange(self.library.get_vocab_size(), dtype=self.dtype)]
        self.parts = _Words(self._part)
        self.bare, self.spaced = _Words(self._word), _Words(self._word, " ")
        self.feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            written = part.replace(" ", "\u0120")
        else:
            written = part.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.codes[t.id] for t in self.library.model.tokenize(written)])

    def _word(self, word: str) -> bytes:
        """``word`` is a word, after a space or not. Letters alone are one part, marks at their end another."""
        stem = word.rstrip(".,;:!?")
        if stem.lstrip(" ").isalpha():
            if len(stem) == len(word):
                return self._part(word)
            return (self.spaced[stem[1:]] if stem[0] == " " else self.bare[stem]) + self.parts[word[len(stem) :]]
        return b"".join([self.parts[p] for p in self.split(word)])

    def _ids(self, text: str) -> bytes:
        # plain texts hold single spaces and line feeds between words and no other white space; a special token stands for itself
        if " ".join(text.split()) != text.replace("\n", " ") or any(s in text for s in self.special):
            return self._whole(text)
        bare, spaced = self.bare, self.spaced.__getitem__
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(bare[words[0]] + b"".join(map(spaced, words[1:])))
        return self.feed.join(lines)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        gc.disable()  # each collection would walk the tables of words
        try:
            return [np.frombuffer(self._ids(t) if t else b"", self.dtype) for t in texts]
        finally:
            gc.enable()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, end_id: int = END_ID) -> np.ndarray:
    return np.append(ids, np.asarray([end_id], ids.dtype))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes()) & 0xFFFFFFFF


def encoded(batches: Iterator[pa.RecordBatch], path: str, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of each text, end id included."""
    enc = encoder(path)
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            yield part, [with_end(x) for x in enc.ids(part.column(text_at).to_pylist())]


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from the id arrays of at most SAMPLE_DOCS documents; small inputs give a raw one, none an empty one."""
    wanted = docs.select("doc_id").agg(F.count("*")).first()[0]
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, wanted))
    limit = int(share * (1 << 30))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit).select(F.substring(text_of(), 1, 8 * SAMPLE_IDS).alias("t")).limit(SAMPLE_DOCS)

    def run(batches):
        for part, ids in encoded(batches, path, 0):
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_IDS].tobytes() for x in ids], pa.binary())], names=["raw"])

    samples = sorted(bytes(r[0]) for r in picked.mapInArrow(run, "raw binary").collect())  # at most SAMPLE_DOCS * SAMPLE_IDS ids
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")


def write_shard(uri: str, rows: Iterator[tuple[int | None, int, bytes]], width: int, digest: bytes) -> tuple[int, int]:
    """Writes (doc_id, number of ids, frame) in the given order; returns the numbers of documents and ids."""
    index = []
    fs, path = _open(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    at = len(MAGIC)
    with fs.open_output_stream(draft) as out:
        out.write(MAGIC)
        for doc_id, n, frame in rows:
            out.write(frame)
            index.append((at, len(frame), n, doc_id or 0, doc_id is None))
            at += len(frame)
        table = np.array(index, INDEX)
        out.write(table.tobytes())
        out.write(TAIL.pack(at, len(index), width, digest, MAGIC))
    fs.move(draft, path)
    return len(index), int(table["n"].sum(dtype="int64"))


class ShardReader:
    """Random and sequential access to the documents of one shard."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n, self.width, digest, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} needs another dictionary")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.plain = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        raw = self.plain.decompress(self.file.read_at(int(e["size"]), int(e["offset"])), max_output_size=int(e["n"]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")

    def doc_id(self, i: int) -> int | None:
        return None if self.index[i]["null"] else int(self.index[i]["doc_id"])

    def find(self, doc_id: int) -> np.ndarray:
        """The ids of one document, by binary search in the index."""
        known = self.index["doc_id"][self.index["null"] == 0]
        i = int(np.searchsorted(known, doc_id))
        if i == len(known) or known[i] != doc_id:
            raise KeyError(doc_id)
        return self.ids(i + len(self.index) - len(known))


def write_ids(docs: DataFrame, folder: str, path: str | None = None, shards: int | None = None) -> tuple[DataFrame, bytes]:
    """Encodes ``docs`` (doc_id, text) into shards below ``folder``. Returns the manifest (shard, uri, docs, tokens) and the dictionary.

    Texts are encoded once, where they are read; what is shuffled to the shards are compressed frames. Borders between shards are
    quantiles of doc_id, so shards follow the document order.
    """
    path = path or public_tokenizer()
    shards = shards or max(1, docs.rdd.getNumPartitions())
    raw = train_dictionary(docs, path)
    digest = hashlib.sha256(raw).digest()
    fs, place = _open(folder)
    fs.create_dir(place, recursive=True)
    with fs.open_output_stream(f"{place}/{digest.hex()}.dict") as out:
        out.write(raw)
    marks = [i / shards for i in range(1, shards)]
    borders = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, marks)), F.lit(10_000))).first()[0] or [])) if marks else []
    shared = docs.sparkSession.sparkContext.broadcast((raw, np.asarray(borders, "int64")))

    def encode(batches):
        dictionary, cuts = shared.value
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_content_size=True)
        for part, ids in encoded(batches, path, 1):
            known = part.column(0).fill_null(np.iinfo("int64").min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(cuts, known, side="left").astype("int32")), part.column(0),
                    pa.array([len(x) for x in ids], pa.int32()), pa.array([press.compress(x.tobytes()) for x in ids], pa.binary()),
                ],
                names=["shard", "doc_id", "n", "frame"],
            )

    def save(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        source = rows()
        head = next(source, None)
        while head is not None:
            shard, after = head[0], []

            def own():
                row = head
                while row is not None and row[0] == shard:
                    yield row[1:]
                    row = next(source, None)
                after.append(row)

            uri = f"{folder}/ids-{shard:06d}"
            n, tokens = write_shard(uri, own(), encoder(path).dtype.itemsize, digest)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "uri", "docs", "tokens"])
            head = after[0]

    frames = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(encode, "shard int, doc_id long, n int, frame binary")
    placed = frames.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
    return materialize(placed.mapInArrow(save, "shard int, uri string, docs long, tokens long"), "ids-manifest"), raw


def read_ids(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files. The manifest has a row per shard."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(manifest.select("shard", "uri", before.alias("start")), "ids-starts")
    shared = manifest.sparkSession.sparkContext.broadcast(dictionary)

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                shard = ShardReader(uri, shared.value)
                for i in range(0, len(shard), 1024):
                    part = range(i, min(i + 1024, len(shard)))
                    n = shard.index["n"][part.start : part.stop].astype("int64")
                    first = start + np.cumsum(n) - n
                    start += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.doc_id(j) for j in part], pa.int64()), pa.array(first), pa.array(n),
                            pa.array([crc(shard.ids(j)) for j in part], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return starts.repartition(max(1, manifest.count()), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame) -> DataFrame:
    """Writes all documents and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return read_ids(*write_ids(docs, scratch_path(docs.sparkSession, "token-ids")))
