"""Operator 2: token ids in a bit-packed binary format.

`encode` tokenizes whole texts and writes them as blocks in ascending document order; `decode` reads them back.
A block holds whole documents: `bits` per id (the least that the vocabulary needs), `payload` with the ids packed
without gaps into little-endian 64-bit words, the documents' ids and where each starts in the block, and `first`, the
position of the block's first id in its shard. Any block can be decoded alone, in any task, and an id's place is found
by binary search over `first`. The blocks are rows of a Parquet folder: commits, retries and remote stores are Spark's.

Nulls and edge cases: a null or empty text is one end id; a null doc_id sorts first; rows that repeat a doc_id are kept,
ordered by the text's hash and then the text; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, scratch_path, slices, table, text_bytes

BLOCK_IDS = 1 << 16
#: Bytes that a worker process spends on keeping the ids of words at hand.
CACHE_BYTES = 40 << 20
#: Characters that are split into parts at a time.
RUN_CHARS = 1 << 20
BLOCKS = "shard long, block long, bits int, first long, n_ids long, doc_ids array<bigint>, doc_starts array<bigint>, payload binary"
_ARROW = pa.schema([
    ("shard", pa.int64()), ("block", pa.int64()), ("bits", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids fill exactly `bits` words, so each of 64 columns goes to fixed places with two shifts."""
    rows = -(-len(ids) // 64)
    grid = np.zeros((64, rows), np.uint64)
    padded = np.zeros(rows * 64, np.uint64)
    padded[: len(ids)] = ids
    grid[:] = padded.reshape(rows, 64).T
    out = np.zeros((bits, rows), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[word] |= grid[k] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= grid[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(payload, "<u8").reshape(-1, bits).T)
    mask = np.uint64((1 << bits) - 1)
    grid = np.empty((64, words.shape[1]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        got = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | words[word + 1] << np.uint64(64 - shift)
        grid[k] = got & mask
    return np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)


def unpack_range(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a block, reading only the groups of 64 that hold them."""
    low, high = start // 64, -(-stop // 64)
    return unpack(payload[low * bits * 8 : high * bits * 8], bits, (high - low) * 64)[start - low * 64 : stop - low * 64]


#: Texts that case folding and NFC leave one for one: of ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
_GAP = re.compile(r"[\t\n\r\x20]")
#: Characters of a plain lower-case text: 0 space, 1 letter, 2 digit, 3 any other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_KIND[48:58] = 2
_CHARS = np.random.default_rng(20240615).integers(1, 1 << 63, 256, dtype=np.uint64)
_CHARS[_KIND == 0] = 0
_POWER = np.uint64(0x9E3779B97F4A7C15)
#: Letters that make a part of their own with an apostrophe before them.
_SHORT = np.zeros(256, bool)
_SHORT[list(b"stmd")] = True


def parts_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of a plain lower-case text in Latin-1 begin and end: runs of letters, digits, runs of other characters but space,
    and an apostrophe with s, t, m, d, re, ve or ll behind it."""
    byte = np.frombuffer(data + b"  ", np.uint8)
    kind = _KIND[byte]
    change = np.append(True, kind[1:] != kind[:-1])
    start = (kind > 0) & (change | (kind == 2))
    at = np.flatnonzero(start & (byte == 39))
    at = at[kind[at + 1] == 1]
    one = at[_SHORT[byte[at + 1]]]
    pair = byte[at + 1].astype(np.int32) << 8 | byte[at + 2]
    two = at[np.isin(pair, [0x7265, 0x7665, 0x6C6C])]
    start[np.concatenate([one, two]) + 1] = False
    for places, n in ((one, 2), (two, 3)):
        places = places[kind[places + n] == 1]
        start[places + n] = True
    edge = np.flatnonzero(start | (change & (kind == 0)))
    first = np.flatnonzero(start[edge])
    return edge[first], edge[np.minimum(first + 1, len(edge) - 1)]


def _byte_letters() -> dict[int, str]:
    """How byte-level models write a byte as a letter: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids (as little-endian bytes) of texts, from those of their parts.

    A tokenizer that drops white space never joins over it, so a text's ids are those of the pieces between spaces and newlines.
    If the tokenizer is of the known layout (NFC, lower case, words with a split pattern, byte letters), plain texts are
    split here, many at once, and each distinct part goes to the library's model; all others take its whole path, piece by piece.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        made = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        kinds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.direct = kinds == ["NFC", "Replace", "Lowercase"] and splits[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
        self.parts = Recent(self._part, CACHE_BYTES)
        self.pieces = Recent(self._piece, CACHE_BYTES // 8)

    def _part(self, part: bytes) -> bytes:
        letters = part.decode("latin-1")
        if not part.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if self._plain(piece):
            return self._many([piece])[0]
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bool:
        return self.direct and _PLAIN.fullmatch(text) is not None and "<|" not in text

    def _many(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: each distinct part of all is looked up once."""
        data = " ".join(texts).lower().encode("latin-1")
        starts, ends = parts_of(data)
        if not len(starts):
            return [b""] * len(texts)
        sizes = ends - starts
        power = np.cumprod(np.append(np.uint64(1), np.full(int(sizes.max()) - 1, _POWER)))
        byte = _CHARS[np.frombuffer(data, np.uint8)[starts[0] :]]
        offset = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        byte *= power[np.minimum(offset, len(power) - 1)]
        code = np.add.reduceat(byte, starts - starts[0]) + sizes.astype(np.uint64) * _POWER
        _, first, of = np.unique(code, return_index=True, return_inverse=True)
        found = list(map(self.parts.__getitem__, [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
        pool = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        before = (np.cumsum(lengths) - lengths)[of]
        lengths = lengths[of]
        stops = np.cumsum(lengths)
        ids = pool[np.repeat(before - stops + lengths, lengths) + np.arange(stops[-1])].tobytes()
        # A text's ids end with those of its last part.
        cuts = np.append(0, stops)[np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))] * 4
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _long(self, text: str) -> bytes:
        """Ids of a long plain text, cut at white space; a piece that has none for long goes to the library."""
        out, at = [], 0
        while at < len(text):
            found = _GAP.search(text, at + RUN_CHARS)
            end = found.start() if found else len(text)
            piece = text[at:end]
            out.append(self._many([piece])[0] if len(piece) <= 8 * RUN_CHARS else array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes())
            at = end
        return b"".join(out)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order; plain texts that follow one another are taken together up to RUN_CHARS."""
        held: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) <= RUN_CHARS and self._plain(text):
                held.append(text)
                size += len(text)
                continue
            if held:
                yield from self._many(held)
                held, size = [], 0
            if self._plain(text):
                held, size = [text], len(text)
                if size > RUN_CHARS:
                    yield self._long(text)
                    held, size = [], 0
            else:
                yield b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        if held:
            yield from self._many(held)


#: The last encoder that this worker process used, by its tokenizer's file: later tasks start with what it knows.
_HELD: dict[str, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    if spec not in _HELD:
        _HELD.clear()
        _HELD[spec] = WordEncoder(spec)
    return _HELD[spec]


def _writer(spec: str, bits: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        from pyspark import TaskContext

        encode_ = encoder(spec).ids
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        end = np.asarray([end_id], "<u4").tobytes()
        held: list[bytes] = []
        names: list = []
        starts: list[int] = []
        size = 0

        def flush():
            nonlocal block, first, held, names, starts, size
            ids = np.frombuffer(b"".join(held), "<u4")
            row = pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "bits": bits, "first": first, "n_ids": size, "doc_ids": names, "doc_starts": starts, "payload": pack(ids, bits)}],
                _ARROW,
            )
            block, first, held, names, starts, size = block + 1, first + size, [], [], [], 0
            return row

        for batch in slices(batches):
            for doc, data in zip(batch.column(0).to_pylist(), encode_([raw.decode("utf-8", "replace") for raw in batch.column(1).to_pylist()]), strict=True):
                data += end
                names.append(doc)
                starts.append(size)
                held.append(data)
                size += len(data) // 4
                if size >= BLOCK_IDS:
                    yield flush()
        if names:
            yield flush()

    return run


def encode(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 1) -> None:
    """Write the packed blocks of `docs` (doc_id, text) to `path`, globally in ascending doc_id order by shard and block.

    tokenizer_json is the tokenizer's own file as text (a fixed few MB), so executors need no copy of the file.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True), end_id + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    # The text's hash deals out a doc_id that many rows share; the range sample reads the table, never the tokenizer.
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(_writer(tokenizer_json, bits_for(vocabulary), end_id), BLOCKS).write.parquet(path)


def _reader(bases: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in slices(batches, rows=8):
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], row["n_ids"]).astype("<u4")
                starts = np.asarray(row["doc_starts"], np.int64)
                ends = np.append(starts[1:], row["n_ids"])
                base = bases[row["shard"]] + row["first"]
                view = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(base + starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def decode(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids, from the files."""
    blocks = read_blocks(spark, path)
    # One number for each shard, that is for each write task.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    bases, at = {}, 0
    for shard, n in totals:
        bases[shard] = at
        at += n
    return blocks.mapInArrow(_reader(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encode_and_read(docs: DataFrame, tokenizer_json: str | None = None, end_id: int = 1) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    encode(docs, tokenizer_json or tokenizer_file(), path, end_id)
    return decode(docs.sparkSession, path)


def op2_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))
