"""Token ids of documents in binary files.

A file is a sequence of groups. A group holds whole documents: their ids and lengths, the
distinct token ids from the most to the least frequent, and for each token its place in
that list, packed by Simple-8b. Ids beyond the first ``DICTIONARY`` of a group are escapes.
Each task writes one file; the manifest, written when all have ended, names the files in order with
their numbers of documents and ids, so a reader knows the global place of each file's first
id. Files of failed or repeated attempts are in no manifest.

Layout: MAGIC, groups, index (first byte and length of each group), 8 bytes length of the
index, MAGIC. All numbers are little-endian.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, utf8
from .simple8b import Packed, pack, unpack

MAGIC = b"S8BTOK1\n"
GROUP_IDS = 1 << 19        # a group ends with the document that reaches this
DICTIONARY = 1 << 16
END_ID = 1
_DENSE = 1 << 22
CACHE_BYTES = 24_000_000     # of pieces and ids that a worker keeps, in each of two generations
_ENTRY = 200                  # bytes of an entry besides its text and ids
# Letters, a contraction, a digit, or marks: where this family of tokenizers cuts lower-cased text.
_PIECES = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\x80-\xff\x20\x09-\x0d]+")


# ---- tokens -----------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as one printable character, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _PieceIds(dict):
    """Ids (as bytes) of each piece met, by the tokenizer.

    Bounded by bytes: when full, its pieces become the older generation, and those met again come back,
    so frequent pieces stay.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.normal, self.letters = tokenizer, tokenizer.model, tokenizer.normalizer, _byte_letters()
        self.older: dict[bytes, bytes] = {}
        self.limit = self.room = CACHE_BYTES

    def __missing__(self, piece: bytes) -> bytes:
        value = self.older.get(piece)
        if value is None:
            # a run of letters goes to the model as it is, anything else through the whole tokenizer
            ids = [t.id for t in self.model.tokenize(piece.decode())] if piece.isalpha() and piece.islower() else self.encode(piece.decode(errors="replace"))
            value = array("I", ids).tobytes()
        if self.room <= 0:
            self.older, self.room = dict(self), self.limit
            self.clear()
        self.room -= _ENTRY + len(piece) + len(value)
        self[piece] = value
        return value

    def encode(self, piece: str) -> list[int]:
        plain = self.normal.normalize_str(piece)
        if plain.isalpha():
            return [t.id for t in self.model.tokenize(plain.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids


class _StaysLetter(dict):
    """By character: ASCII, or a letter that is one still when composed and lower-cased (a dotted capital I is not)."""

    def __missing__(self, c: str) -> bool:
        value = self[c] = c < "\x80" or unicodedata.normalize("NFC", c).lower().isalpha()
        return value


class Encoder:
    """Texts to ids as bytes of little-endian 32-bit integers, ``end_id`` last.

    ``by_word`` encodes each distinct piece once. It is right only for byte-level tokenizers that
    drop white space, lower-case, and split at the places of ``_PIECES``; texts with other
    characters than ASCII and letters, or with a special token, are cut at white space only.
    """

    def __init__(self, spec: str, by_word: bool, end_id: int = END_ID, cache_bytes: int = CACHE_BYTES):
        import tokenizers

        self.specials = [t["content"].encode() for t in json.loads(spec)["added_tokens"]]
        self.letter = _StaysLetter()
        self.by_word, self.tail = by_word, np.array([end_id], "<u4").tobytes()
        # kept on the library's module, so that it lives as long as the worker and serves all its tasks
        name = f"piece_ids_{uuid.uuid5(uuid.NAMESPACE_OID, spec).hex}"
        self.known = vars(tokenizers).get(name)
        if self.known is None:
            self.known = _PieceIds(tokenizers.Tokenizer.from_str(spec))
            setattr(tokenizers, name, self.known)
        self.known.limit, self.known.room = cache_bytes, min(self.known.room, cache_bytes) if self.known else cache_bytes

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return np.array(self.known.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes() + self.tail
        return b"".join(map(self.known.__getitem__, self.pieces(text))) + self.tail

    def pieces(self, text: bytes) -> list[bytes]:
        if any(s in text for s in self.specials):
            return text.split()
        text = text.lower()   # A to Z only: the tokenizer does so too
        if text.isascii() or all(map(self.letter.__getitem__, set(text.decode(errors="replace")))):
            return _PIECES.findall(text)
        return text.split()


def token_ids(spark: SparkSession, text: str | Column, tokenizer: str, by_word: bool = False) -> Column:
    """The same as a column. ``tokenizer`` is the path of a tokenizers file on the driver; its content is sent to the executors."""
    sent = spark.sparkContext.broadcast(_spec(tokenizer))

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        encode = Encoder(sent.value, by_word)
        return pa.array([encode(t.as_py()) for t in texts], type=pa.binary())

    return run(utf8(text))


def _spec(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


# ---- groups of documents ----------------------------------------------------------------

def pack_group(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    lengths = np.array([len(b) // 4 for b in ids], np.int64)
    stream = np.frombuffer(b"".join(ids), "<u4")
    if len(stream) and stream.max() < _DENSE:   # a vocabulary: count without sorting
        counts = np.bincount(stream)
        known = np.flatnonzero(counts)
        order = np.argsort(-counts[known], kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[known[order]] = np.arange(len(known))
        values = rank[stream]
    else:
        known, place, counts = np.unique(stream, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        values = rank[place]
    rare = values >= DICTIONARY
    packed = pack(np.where(rare, stream, values), rare)
    head = np.array([len(ids), len(stream), len(packed.blocks), len(packed.words), len(packed.escapes), min(len(known), DICTIONARY)], "<i8")
    return b"".join([
        head.tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<i8").tobytes(),
        known[order][:DICTIONARY].astype("<u4").tobytes(), packed.blocks.astype("<i8").tobytes(),
        packed.words.astype("<u8").tobytes(), packed.escapes.astype("<u8").tobytes()])


def unpack_group(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, all ids in order)."""
    n_docs, n_ids, n_blocks, n_words, n_escapes, n_known = np.frombuffer(data, "<i8", 6).tolist()
    at = 48

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    there, doc_ids, lengths = take("u1", n_docs), take("<i8", n_docs), take("<i8", n_docs)
    known, blocks, words, escapes = take("<u4", n_known), take("<i8", n_blocks), take("<u8", n_words), take("<u8", n_escapes)
    values = unpack(Packed(n_ids, words, blocks, escapes))
    ids = np.zeros(n_ids, "<u4")
    if n_ids:
        escaped = _escaped(n_ids, words, blocks)
        ids[escaped] = values[escaped]
        ids[~escaped] = known[values[~escaped].astype(np.int64)]
    return [d if t else None for d, t in zip(doc_ids.tolist(), there.tolist(), strict=True)], lengths, ids


def _escaped(n: int, words: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which values of a group came from escapes: unpack the escapes alone as ones."""
    marks = words.copy()
    escape = words >> np.uint64(60) == 0
    if not escape.any():
        return np.zeros(n, bool)
    marks[~escape] &= np.uint64(0xF) << np.uint64(60)
    marks[escape] = 0
    return unpack(Packed(n, marks, blocks, np.ones(1, np.uint64))) == 1


# ---- files ------------------------------------------------------------------------------------

SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, by_word: bool = False, id_col: str = "doc_id", text_col: str = "text",
                 cache_bytes: int = CACHE_BYTES) -> None:
    """Encode all texts and write them in ascending order of the id (nulls first, equal ids by text).

    Ranges go over (id, text hash), so that even one id with very many rows is spread. Each
    task writes one file; the manifest is written when all have ended.
    """
    spark = docs.sparkSession
    keys = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    sent = spark.sparkContext.broadcast(_spec(tokenizer))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(sent.value, by_word, cache_bytes=cache_bytes)
        pairs = ((i.as_py(), encode(t.as_py())) for batch in batches for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True))
        done = _write_file(path, TaskContext.get().partitionId(), pairs)
        if done["docs"]:
            yield pa.RecordBatch.from_pylist([done])

    _commit(path, ordered.select("doc_id", utf8("text").alias("text")).mapInArrow(write, "order long, name string, docs long, ids long"))


def write_ids(rows: DataFrame, path: str) -> None:
    """The same for rows (doc_id, ids as bytes) that are in order already, partition by partition."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((i.as_py(), t.as_py()) for batch in batches for i, t in zip(batch.column("doc_id"), batch.column("ids"), strict=True))
        done = _write_file(path, TaskContext.get().partitionId(), pairs)
        if done["docs"]:
            yield pa.RecordBatch.from_pylist([done])

    _commit(path, rows.select("doc_id", "ids").mapInArrow(write, "order long, name string, docs long, ids long"))


def _write_file(path: str, order: int, pairs: Iterator[tuple[int | None, bytes]]) -> dict:
    """One file under a name of its own; its place in the order, name, documents and ids."""
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    name = f"tokens-{order:06d}-{uuid.uuid4().hex}.s8b"
    index, docs, total, doc_ids, ids, held = [], 0, 0, [], [], 0
    with fs.open_output_stream(f"{folder}/{name}") as out:
        out.write(MAGIC)
        at = len(MAGIC)

        def flush():
            nonlocal at, doc_ids, ids, held
            if ids:
                data = pack_group(doc_ids, ids)
                out.write(data)
                index.append((at, len(data)))
                at += len(data)
                doc_ids, ids, held = [], [], 0

        for doc_id, mine in pairs:
            doc_ids.append(doc_id)
            ids.append(mine)
            docs, total, held = docs + 1, total + len(mine) // 4, held + len(mine) // 4
            if held >= GROUP_IDS:
                flush()
        flush()
        footer = np.array(index, "<i8").tobytes()
        out.write(footer + np.array([len(footer)], "<i8").tobytes() + MAGIC)
    return {"order": order, "name": name, "docs": docs, "ids": total}


def _commit(path: str, written: DataFrame) -> None:
    """Run the writers and list what the attempts that succeeded have written: one row per file."""
    files = [{"name": r.name, "docs": r.docs, "ids": r.ids} for r in sorted(written.collect(), key=lambda r: r.order)]
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"files": files}).encode())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids as bytes; a task per file."""
    fs, folder = filesystem(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    start, parts = 0, []
    for f in files:
        parts.append((f"{path}/{f['name']}", start))
        start += f["ids"]
    table = spark.createDataFrame(parts, "path string, start long").repartition(max(1, len(parts)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(row["path"], row["start"])

    return table.mapInArrow(read, SCHEMA)


def _read_file(file: str, start: int) -> Iterator[pa.RecordBatch]:
    """A batch for each group, found by the index at the end of the file."""
    fs, path = filesystem(file)
    with fs.open_input_file(path) as f:
        end = f.size() - len(MAGIC)
        f.seek(end - 8)
        size = int(np.frombuffer(f.read(8), "<i8")[0])
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file, or was cut off")
        f.seek(end - 8 - size)
        for at, length in np.frombuffer(f.read(size), "<i8").reshape(-1, 2).tolist():
            f.seek(at)
            doc_ids, lengths, ids = unpack_group(f.read(length))
            stop = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), pa.array(start + stop - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([ids[b - n:b].tobytes() for b, n in zip(stop.tolist(), lengths.tolist(), strict=True)], pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])
            start += int(stop[-1])


def token_table(docs: DataFrame, path: str, tokenizer: str, by_word: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Write ``docs`` to ``path`` and read the files back: doc_id, start, n_tokens, ids_crc32.

    ``cache_bytes``, twice, is what each worker keeps of pieces encoded by word: a larger one saves time.

    Defined results: null and empty texts are the end id alone; a null id comes first and is
    read back as null; repeated rows are written each; an empty table gives no rows.
    """
    write_tokens(docs, path, tokenizer, by_word, cache_bytes=cache_bytes)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
