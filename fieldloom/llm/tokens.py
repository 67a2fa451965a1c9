"""Token ids as files: interleaved static range asymmetric numeral coding under one shared frequency table.

Format.  A dataset is a folder that needs nothing else to be read: ``table`` holds one row (version, vocabulary, scale,
end_id, ids, frequencies, checksum) and ``frames`` the code, both Parquet.  A frame is a row (shard, first, doc_ids, lengths,
n_tokens, payload): the documents it holds in order, their token counts, and a payload that can be decoded on its own:
  header    '<4sHHQIIII': magic, version, log2 of the table's total, tokens, lanes, steps between checkpoints,
            checkpoints, 32-bit words
  points    for each checkpoint, the word offset (u64) and the lanes' states (u64 each); decoding may start at any
  words     the code, u32
  checksum  crc32 of all before it
Token i of a frame belongs to lane i mod lanes.  Shards are ranges of the order, ascending; frames ascend in a shard by
first, the number of documents before them in the shard.  read() decodes frames in parallel, each from its first checkpoint;
decode_frame() starts at any.

Defined results: a null text counts as empty, and an empty text is its end id alone; without an order given, rows of one doc_id
stand next to each other, ordered by a digest of their text, and null doc_ids come first; no rows give no frames and an empty
table; other columns are left out.  Special tokens count as such in their own letter case only, as the tokenizer has it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, drop_cut, shared_dir, tidy

MAGIC, VERSION, HEADER = b"FLTK", 1, struct.Struct("<4sHHQIIII")
LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
FRAME_TOKENS, LANES, POINT_STEPS = 1 << 20, 4096, 128
FRAME_SCHEMA = "shard int, first long, doc_ids array<long>, lengths array<long>, n_tokens long, payload binary"
TABLE_SCHEMA = "version int, vocabulary long, scale int, end_id long, ids binary, frequencies binary, checksum long"
BATCH_CHARS = 800_000  # of texts encoded together
CACHED_PIECES = 600_000  # about 40 MB a worker


class FrequencyTable:
    """How many of the 2^scale slots each id has."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, vocabulary: int, scale: int):
        self.scale = scale
        self.freq = np.zeros(vocabulary, np.uint64)
        self.freq[ids] = freq
        self.start = np.zeros(vocabulary, np.uint64)
        self.start[1:] = np.cumsum(self.freq)[:-1]
        self.slots: np.ndarray | None = None

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> FrequencyTable:
        """Counts scaled to a power of two; every id that occurs has at least one slot."""
        scale = max(12, int(len(ids)).bit_length() + 4)
        total = 1 << scale
        freq = np.maximum(1, np.floor(counts * (total / max(1, counts.sum()))).astype(np.int64))
        order = np.argsort(-freq, kind="stable")
        while (over := int(freq.sum() - total)) > 0:  # only the clamped ones can push it over
            take = np.minimum(freq[order] - 1, -(-over // max(1, int((freq[order] > 1).sum()))))
            take = np.minimum(take, np.maximum(0, over - np.r_[0, np.cumsum(take)[:-1]]))
            freq[order] -= take
        if len(freq):
            freq[order[0]] += total - freq.sum()
        return cls(ids, freq, vocabulary, scale)

    def pack(self) -> tuple[int, int, int, bytes, bytes, int]:
        """(version, vocabulary, scale, ids u32, frequencies u32, crc32 of the five before)."""
        ids = np.flatnonzero(self.freq).astype("<u4")
        parts = VERSION, len(self.freq), self.scale, ids.tobytes(), self.freq[ids].astype("<u4").tobytes()
        return *parts, zlib.crc32(struct.pack("<IQI", *parts[:3]) + parts[3] + parts[4])

    @classmethod
    def unpack(cls, version: int, vocabulary: int, scale: int, ids: bytes, freq: bytes, checksum: int) -> FrequencyTable:
        if version != VERSION:
            raise ValueError(f"token files of version {version}; this reads {VERSION}")
        if zlib.crc32(struct.pack("<IQI", version, vocabulary, scale) + ids + freq) != checksum:
            raise ValueError("the table's checksum doesn't hold")
        return cls(np.frombuffer(ids, "<u4"), np.frombuffer(freq, "<u4"), vocabulary, scale)

    def symbol_of_slot(self) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self.slots


def encode_frame(tokens: np.ndarray, table: FrequencyTable, lanes: int = LANES, every: int = POINT_STEPS) -> bytes:
    n = len(tokens)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    freq, start, scale = table.freq[tokens], table.start[tokens], np.uint64(table.scale)
    limit = freq << (np.uint64(63) - scale)
    state = np.full(lanes, LOW)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    points: list[np.ndarray] = []
    for t in reversed(range(steps)):
        own = slice(t * lanes, min(n, (t + 1) * lanes))
        x, f = state[: own.stop - own.start], freq[own]
        full = x >= limit[own]
        words[t] = x[full].astype(np.uint32)
        x[full] >>= np.uint64(32)
        q = x // f
        x[:] = (q << scale) + (x - q * f) + start[own]
        if t % every == 0:
            points.append(state.copy())
    points.reverse()
    offsets = np.r_[0, np.cumsum([len(w) for w in words])].astype("<u8")
    code = np.concatenate(words).astype("<u4") if steps else np.empty(0, "<u4")
    body = HEADER.pack(MAGIC, VERSION, table.scale, n, lanes, every, len(points), len(code))
    body += b"".join(offsets[i * every].tobytes() + p.astype("<u8").tobytes() for i, p in enumerate(points)) + code.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frame(payload: bytes, table: FrequencyTable, first_point: int = 0, n_points: int | None = None) -> np.ndarray:
    """The tokens of a frame, or of n_points checkpoints from first_point on."""
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("a frame's checksum doesn't hold")
    magic, version, scale, n, lanes, every, points, n_words = HEADER.unpack_from(payload)
    if (magic, version, scale) != (MAGIC, VERSION, table.scale):
        raise ValueError("not a frame of this table")
    if not n:
        return np.empty(0, np.uint32)
    size = 8 + 8 * lanes
    at = HEADER.size + size * first_point
    offset = int.from_bytes(payload[at : at + 8], "little")
    state = np.frombuffer(payload, "<u8", lanes, at + 8).astype(np.uint64)
    code = np.frombuffer(payload, "<u4", n_words, HEADER.size + size * points)
    begin, end = first_point * every * lanes, n if n_points is None else min(n, (first_point + n_points) * every * lanes)
    out = np.empty(end - begin, np.uint32)
    symbol, mask, shift = table.symbol_of_slot(), np.uint64((1 << scale) - 1), np.uint64(scale)
    for a in range(0, end - begin, lanes):
        b = min(end - begin, a + lanes)
        x = state[: b - a]
        slot = x & mask
        s = symbol[slot]
        out[a:b] = s
        x[:] = table.freq[s] * (x >> shift) + slot - table.start[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | code[offset : offset + len(low)]
        offset += len(low)
    return out


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, by way of their distinct words.

    Only for tokenizers that fold case and whose ids never depend on what stands beyond white space.  Words are runs between
    ASCII white space, without the signs that follow their last letter or digit, which the tokenizer splits off too; those of a batch are told apart by their bytes in NumPy, so only distinct ones are looked up, in a bounded memory of
    words that outlives the batch, and only new ones are encoded.  A text with a special token, in whatever letter case, goes to the
    tokenizer whole, for only the tokenizer tells the token from its look-alikes.
    """

    TAIL = b".,;:!?*#%$&)"  # signs that stand as one run after a word
    LINE = 256  # words encoded in one call
    WIDE = 24  # bytes of a word that are compared at once; longer words are looked up one by one

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = tuple(t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(size, bool)
        if suffix:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        blank, self.plain = b"\t\n\x0b\x0c\r ", np.zeros(256, bool)
        self.plain[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
        self.kinds = np.array([0 if c in blank else 1 if c in self.TAIL else 2 for c in range(256)], np.uint8)
        self.cased = bool(self.ids("A") != self.ids("a"))
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def forget(self) -> None:
        """Known words: sorted hashes, the bytes that they stand for, and where their ids lie in the pool."""
        self.hashes, self.keys = np.empty(0, np.uint64), np.empty((0, 1 + self.WIDE // 8), np.uint64)
        self.places, self.counts, self.pool = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, self.kind)

    def code(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each word in them, ids of each word).  Latin letters alone end with their only token that carries the
        end-of-word mark, so that many are encoded in one line; anything else is encoded by itself."""
        latin, rest = [], []
        marked = bool(self.ends_word.any())
        for n, word in enumerate(words):
            if marked and (word.isalpha() or (not word.isascii() and (text := word.decode()).isalpha() and max(text) < "\u0250")):
                latin.append(n)
            else:
                rest.append(n)
        lines = [latin[i : i + self.LINE] for i in range(0, len(latin), self.LINE)]
        ids, order, counts = [], [], []
        for line, coded in zip(lines, self.tokenizer.encode_batch_fast([b" ".join([words[n] for n in x]).decode() for x in lines], add_special_tokens=False), strict=True):
            data = np.array(coded.ids, self.kind)
            end = np.flatnonzero(self.ends_word[data]) + 1
            if len(end) == len(line):
                ids.append(data)
                order += line
                counts.append(np.diff(end, prepend=0))
            else:
                rest += line
        for n, coded in zip(rest, self.tokenizer.encode_batch_fast([words[n].decode() for n in rest], add_special_tokens=False), strict=True):
            ids.append(np.array(coded.ids, self.kind))
            order.append(n)
            counts.append([len(coded.ids)])
        count = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        place, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        place[order], size[order] = np.cumsum(count) - count, count
        return np.concatenate(ids) if ids else np.empty(0, self.kind), place, size

    def look_up(self, words: list[bytes], hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each word in them, ids of each word), learning what is new."""
        if len(self.hashes) > CACHED_PIECES:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, max(0, len(self.hashes) - 1))
        taken = self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(words), bool)
        short = keys[:, 0] <= self.WIDE
        known = taken & short & ((self.keys[near] == keys).all(axis=1) if len(self.hashes) else False)
        new = np.flatnonzero(~known)
        place, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        place[known], count[known] = self.places[near[known]], self.counts[near[known]]
        ids, own, size = self.code([words[i] for i in new.tolist()])
        place[new], count[new] = own + len(self.pool), size
        table = np.concatenate([self.pool, ids])
        keep = new[short[new] & ~taken[new]]
        keep = keep[np.argsort(hashes[keep])]
        keep = keep[np.r_[True, np.diff(hashes[keep]) > 0]] if len(keep) else keep
        if len(keep):
            where = np.searchsorted(self.hashes, hashes[keep])
            self.hashes, self.keys = np.insert(self.hashes, where, hashes[keep]), np.insert(self.keys, where, keys[keep], axis=0)
            self.places, self.counts, self.pool = np.insert(self.places, where, place[keep]), np.insert(self.counts, where, count[keep].astype(np.int32)), table
        return table, place, count

    def bounds(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of data, which begins and ends with white space."""
        low = np.frombuffer(data, np.uint8, len(data) - self.WIDE - 8)
        kind = self.kinds[low]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1  # starts of runs of a kind, but for the first run
        of = kind[edge]
        after = np.r_[of[1:], 0].astype(np.uint8)
        tail = edge[(of == 1) & (after == 0) & self.plain[low[edge - 1]]]
        start = edge[(of > 0) & (kind[edge - 1] == 0)]
        end = edge[of == 0]
        return np.sort(np.concatenate([start, tail])), np.sort(np.concatenate([end, tail]))

    def distinct(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(one place of each distinct word, number of each word among them, and the distinct words' hashes and bytes);
        data has WIDE bytes of padding."""
        size = end - start
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        parts = [eight[start + k] & self.masks[np.clip(size - k, 0, 8)] for k in range(0, self.WIDE, 8)]
        h = size.astype(np.uint64)
        for part in parts:
            h = (h ^ part ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        order = np.argsort(h)
        ranked = h[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(order) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        place = order[new]
        alone = size > self.WIDE  # a longer word may only start like another
        same = ~alone
        for x in (size, *parts):
            same &= x[place][number] == x
        odd = np.flatnonzero(~same)
        number[odd] = len(place) + np.arange(len(odd))
        place = np.r_[place, odd]
        return place, number, h[place], np.stack([size.astype(np.uint64), *parts], axis=1)[place]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with an end id after each, ids of each text)."""
        raw = [t.encode() for t in texts]
        joined, whole = b"\n".join(raw).lower(), {}
        if any(c in joined for c in self.special):
            whole = {i: self.ids(t) for i, t in enumerate(texts) if any(c in raw[i].lower() for c in self.special)}
            raw = [b"" if i in whole else r for i, r in enumerate(raw)]
        data = b"\n".join([b"", *raw, bytes(self.WIDE + 8)])
        if not self.cased:
            data = data.lower()
        start, end = self.bounds(data)
        place, number, hashes, keys = self.distinct(data, start, end)
        words = [data[a:b] for a, b in zip(start[place].tolist(), end[place].tolist(), strict=True)]
        table, offset, count = self.look_up(words, hashes, keys)
        extra = [np.array([end_id], self.kind), *(np.frombuffer(x, self.kind) for x in whole.values())]
        sizes = np.array([len(x) for x in extra])
        offset, count = np.r_[offset, len(table) + np.cumsum(sizes) - sizes], np.r_[count, sizes]
        table = np.concatenate([table, *extra])
        stops = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]) + 1)  # words before the end of each text
        after = np.full(len(texts), len(words))
        number = np.insert(number, stops, after)
        if whole:
            at = stops[list(whole)] + list(whole)  # just before those texts' end ids
            number = np.insert(number, at, len(words) + 1 + np.arange(len(whole)))
        last = np.flatnonzero(number == len(words))
        own = count[number]
        total = np.cumsum(own)
        ids = table[np.repeat(offset[number] - (total - own), own) + np.arange(int(total[-1]) if len(total) else 0)]
        return ids, np.diff(np.r_[0, total[last]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks share its memory."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, order: Sequence[Column] = ()) -> DataFrame:
    """(shard, ordinal, doc_id, ids binary, counts binary), in order over the shards; a row of ordinal -1 has counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, counts = 0, None
        for whole in batches:
            coder = encoder(tokenizer_path)
            at = 0
            while at < whole.num_rows:
                texts, held = [], 0
                while at + len(texts) < whole.num_rows and held < BATCH_CHARS:
                    texts.append(whole.column(1)[at + len(texts)].as_py() or "")
                    held += len(texts[-1])
                ids, sizes = coder.encode(texts, end_id)
                found = np.bincount(ids, minlength=vocabulary)
                counts = found if counts is None else counts + found
                ends = (np.r_[0, np.cumsum(sizes)] * coder.kind.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, len(texts)), pa.array(range(done, done + len(texts)), pa.int64()), packed, pa.nulls(len(texts), pa.binary())], ["doc_id", "ordinal", "ids", "counts"])
                at += len(texts)
                done += len(texts)
        if counts is not None:  # how often the task has seen each id
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()])], ["doc_id", "ordinal", "ids", "counts"])

    keys = list(order) or [F.col("doc_id").cast("long"), F.xxhash64("text")]
    named = [f"order{i}" for i in range(len(keys))]
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *[k.alias(n) for k, n in zip(keys, named, strict=True)])
    dealt = base.repartitionByRange(*named).sortWithinPartitions(*named).select("doc_id", "text")
    coded = dealt.mapInArrow(tidy(run), "doc_id long, ordinal long, ids binary, counts binary")
    return coded.select(F.spark_partition_id().alias("shard"), "ordinal", "doc_id", "ids", "counts")


def count_ids(ids: DataFrame, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur in all documents and how often; at most one row for each id of the vocabulary comes here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_py(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = ids.where("ordinal < 0").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def encode_frames(ids: DataFrame, table: FrequencyTable, kind: str) -> DataFrame:
    """Frames of whole documents: about FRAME_TOKENS tokens, or one document if it has more."""
    names = ["shard", "first", "doc_ids", "lengths", "n_tokens", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tokens, width = 0, np.dtype(kind).itemsize

        def out() -> pa.RecordBatch:
            payload = encode_frame(np.frombuffer(b"".join(x[3] for x in held), kind), table)
            row = [held[0][0], held[0][1], [x[2] for x in held], [len(x[3]) // width for x in held], tokens, payload]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                shard, ordinal, doc_id, data = (v.as_py() for v in row)
                if held and (tokens >= FRAME_TOKENS or (shard, ordinal) != (held[-1][0], held[-1][1] + 1)):
                    yield out()
                    held, tokens = [], 0
                held.append((shard, ordinal, doc_id, data))
                tokens += len(data) // width
        if held:
            yield out()

    return ids.where("ordinal >= 0").select("shard", "ordinal", "doc_id", "ids").mapInArrow(tidy(run), FRAME_SCHEMA)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, order: Sequence[Column] = ()) -> None:
    """Write docs to token files at path: in the given order of columns, or by doc_id."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    ids = cut(tokenize(docs, tokenizer_path, end_id, vocabulary, order), "token-ids")
    table = FrequencyTable.of_counts(*count_ids(ids, vocabulary), vocabulary)
    version, size, scale, found, freq, checksum = table.pack()
    row = (version, size, scale, end_id, bytearray(found), bytearray(freq), checksum)
    spark.createDataFrame([row], TABLE_SCHEMA).coalesce(1).write.parquet(f"{path}/table")
    encode_frames(ids, table, kind).write.option("compression", "zstd").parquet(f"{path}/frames")
    drop_cut(ids)


def read_table(spark: SparkSession, path: str) -> FrequencyTable:
    rows = spark.read.schema(TABLE_SCHEMA).parquet(f"{path}/table").collect()
    if len(rows) != 1:
        raise ValueError(f"{path} holds {len(rows)} tables instead of one")
    own = rows[0]
    return FrequencyTable.unpack(own["version"], own["vocabulary"], own["scale"], bytes(own["ids"]), bytes(own["frequencies"]), own["checksum"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first, inside, doc_id, ids array<int>) of every document in the token files at path."""
    table = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, doc_ids, lengths, payload = (batch.column(c)[i].as_py() for c in range(5))
                data, ends = decode_frame(payload, table).astype(np.int32), np.r_[0, np.cumsum(lengths)].astype(np.int32)
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([first] * n, pa.int64()), pa.array(ends[:-1].astype(np.int64)), pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(data))], ["shard", "first", "inside", "doc_id", "ids"])

    return frames_at(spark, path).mapInArrow(tidy(run), "shard int, first long, inside long, doc_id long, ids array<int>")


def frames_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).parquet(f"{path}/frames").select("shard", "first", "doc_ids", "lengths", "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the token files at path alone."""
    table = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, doc_ids, lengths, payload = (batch.column(c)[i].as_py() for c in range(5))
                data = decode_frame(payload, table).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(memoryview(data)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([first] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - np.array(lengths)), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["shard", "first", "doc_id", "inside", "n_tokens", "ids_crc32"])

    each = frames_at(spark, path).mapInArrow(tidy(run), "shard int, first long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    size = spark.read.schema(FRAME_SCHEMA).parquet(f"{path}/frames").select("shard", "first", "n_tokens")
    shards = size.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each task that wrote
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("first")) - F.col("n_tokens")
    starts = size.select("shard", "first", inner.alias("frame_start")).join(before, "shard")
    return each.join(starts, ["shard", "first"]).select("doc_id", (F.col("shard_start") + F.col("frame_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, end_id: int = 2, order: Sequence[Column] = ()) -> DataFrame:
    """Write docs to token files and read them back; without a path they go to the shared folder."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id, order)
    return read(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.common import table

    return token_table(table(spark, sf_dir, "documents"))
