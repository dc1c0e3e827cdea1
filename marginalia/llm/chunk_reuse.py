"""BPE encoding by chunks that documents share.

Texts are cut into chunks where a rolling hash of the last bytes says so, so a passage that occurs in many documents
is cut in the same way in each. Chunks that occur more than once are encoded once and their ids go to every place;
the stretches between them are encoded where they stand. A cut may go through a word, so the ids beside a joint
can be wrong: the joint is encoded again, over a window that grows by words, and by whole chunks without a white space,
until the window ends at white space on both sides. Words are encoded on their own, so from there on the ids held
agree with those of the whole text.

Only ids, digests and one copy of each shared chunk are shuffled. Whether a chunk is shared is looked up in a bit filter
of bounded size: where it errs, a chunk that occurs once takes the way of shared ones, which changes no result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import materialize
from .batches import free_name, shared_state, text_chunks
from .token_counts import byte_letters

MAX_MODEL_FILE = 64 << 20
WINDOW_BITS = 5
MIN_CHUNK, MAX_CHUNK = 128, 4096
CUT_BITS = 9
FILTER_BITS = 26
FILTER_KEYS = 3
MEMO_PIECES, MEMO_WORDS = 3 << 16, 1 << 15
KEY_LENGTH = 64
#: Texts that are joined at a time.
ROWS = 256
#: Texts that lower-casing and normalising treat as Python does, and the pieces that are merged on their own in them.
PLAIN = re.compile("[ \\t-\\r!-~À-ÖØ-öø-ÿ]*").fullmatch
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\t-\\ra-z0-9ß-öø-ÿ]+").findall

_PART = T.StructType(
    [
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("head", T.BinaryType()),
        T.StructField("head_n", T.IntegerType()),
        T.StructField("tail", T.BinaryType()),
        T.StructField("tail_n", T.IntegerType()),
    ]
)
_CODED = _PART.names[2:]
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
_PARTS = pa.list_(pa.struct(list(zip(_PART.names, _KINDS))))


class ModelError(ValueError):
    """The model file is too large to be given to every executor."""


def read_tokenizer(path: str) -> str:
    """The model file at ``path`` on the driver; its size is checked, as every executor gets a copy."""
    with open(path, encoding="utf-8") as file:
        content = file.read(MAX_MODEL_FILE + 1)
    if len(content) > MAX_MODEL_FILE:
        raise ModelError(f"{path} is larger than {MAX_MODEL_FILE} characters")
    return content


def _gears() -> np.ndarray:
    """A fixed random number for each byte."""
    digests = (blake2b(bytes([byte]), digest_size=4).digest() for byte in range(256))
    return np.frombuffer(b"".join(digests), dtype="<u4")


GEARS = _gears()


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last 32 bytes allows a cut: ends of chunks, never within a character.

    The hash of a window is the sum of its bytes' numbers, each shifted by its distance from the end; windows are doubled
    until they have their length.
    """
    rolled = GEARS[data]
    for step in range(WINDOW_BITS):
        width = 1 << step
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint32(width)
        rolled = longer
    good = (rolled >> np.uint32(32 - CUT_BITS)) == 0
    inside = np.r_[(data[1:] & 0xC0) == 0x80, False]
    return np.flatnonzero(good & ~inside) + 1


def _character_end(content: memoryview, at: int) -> int:
    while at < len(content) and content[at] & 0xC0 == 0x80:
        at += 1
    return at


def cuts_of(content: memoryview, allowed: np.ndarray) -> list[int]:
    """The ends of a text's chunks; ``allowed`` are the sorted places, from the start of the text, where a cut may be."""
    ends, start, size = [], 0, len(content)
    while size - start > MIN_CHUNK:
        at = int(np.searchsorted(allowed, start + MIN_CHUNK))
        end = min(int(allowed[at]) if at < len(allowed) else size, start + MAX_CHUNK, size)
        start = end if end == size else _character_end(content, end)
        ends.append(start)
    if start < size:
        ends.append(size)
    return ends


def chunked(column: pa.Array) -> Iterator[tuple[memoryview, list[int]]]:
    """Each text of an Arrow column with the ends of its chunks; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    content = memoryview(held)[offsets[0] : offsets[-1]] if held is not None else memoryview(b"")
    places = cut_places(np.frombuffer(content, np.uint8)) if len(content) > MIN_CHUNK else np.empty(0, np.int64)
    starts = offsets - offsets[0]
    first = np.searchsorted(places, starts)
    for row in range(len(texts)):
        start, end = int(starts[row]), int(starts[row + 1])
        text = content[start:end]
        yield text, cuts_of(text, places[first[row] : first[row + 1]] - start)


def chunk_digest(chunk: memoryview) -> tuple[int, int]:
    digest = blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def filter_places(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """The places of a digest in the bit filter."""
    first, second = h1.view(np.uint64), h2.view(np.uint64)
    return [((first + second * np.uint64(k)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for k in range(FILTER_KEYS)]


class Recent(dict):
    """Codes by key, in two generations: when the newer one is full it becomes the older one, which is dropped."""

    def __init__(self, code: Callable[[object], bytes], most: int) -> None:
        super().__init__()
        self.code, self.most, self.older = code, most, {}

    def __missing__(self, key: str | bytes) -> bytes:
        coded = self.older.get(key)
        if coded is None:
            coded = self.code(key)
        if len(key) <= KEY_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = coded
        return coded


class WordEncoder:
    """Codes of texts by the tokenizer library, word by word; what comes again is looked up.

    Codes are ids of two bytes each, four for larger vocabularies; in tables they are compressed. Plain text, of printable ASCII and the letters of
    Latin-1, is cut into pieces here, which go to the library's merges; any other word goes through all of the library.
    """

    def __init__(self, model: str) -> None:
        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        names = self.library.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values(), default=-1) + 1)
        for name, at in names.items():
            self.names[at] = name
        self.kind = "H" if len(self.names) <= 1 << 16 else "I"
        self.letters = dict(enumerate(byte_letters()))
        self.merge = self.library.model.tokenize
        added = [re.escape(token.content) for token in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or "(?!)").search
        self.pack, self.unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        self.pieces = Recent(self._piece, MEMO_PIECES)
        self.words = Recent(self._odd_word, MEMO_WORDS)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [token.id for token in self.merge(shown)]).tobytes()

    def _odd_word(self, word: bytes) -> bytes:
        return array(self.kind, self.library.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES(text.lower())))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        return self._plain(text) if PLAIN(text) and not self.special(text) else self.words[word]

    def encode(self, text: bytes) -> bytes:
        """The codes of a text; white space between words gives none, so words stand on their own."""
        shown = text.decode()
        if PLAIN(shown) and not self.special(shown):
            return self._plain(shown)
        return b"".join(map(self._word, text.split()))

    def ids(self, codes: bytes) -> np.ndarray:
        return np.frombuffer(codes, self.kind).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))

    def coded(self, chunk: bytes) -> tuple[bytes, bytes, int, bytes | None, int]:
        """A chunk's packed codes, its head up to the first white space and its tail from the last on, each with its count of bytes.

        A chunk without white space is all head and has no tail.
        """
        codes = self.encode(chunk)
        words = chunk.split(None, 1)
        head = b"" if chunk[:1].isspace() or not words else words[0]
        if len(head) == len(chunk):
            return self.pack(codes), chunk, len(codes), None, 0
        tail = b"" if chunk[-1:].isspace() else chunk.rsplit(None, 1)[-1]
        return self.pack(codes), head, len(self.encode(head)), tail, len(self.encode(tail))


def joined(parts: list[dict], encoder: WordEncoder) -> bytes:
    """The codes of a text from those of its parts, with every joint encoded again.

    ``open_`` is the text since the last white space: it is not settled until white space follows.
    """
    settled, open_, encode = [], b"", encoder.encode
    for part in parts:
        if part["tail"] is None:
            open_ += part["head"]
            continue
        codes = encoder.unpack(part["codes"])
        settled.append(encode(open_ + part["head"]))
        settled.append(codes[part["head_n"] : len(codes) - part["tail_n"]])
        open_ = part["tail"]
    settled.append(encode(open_))
    return b"".join(settled)


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """``(h1, h2, n)``: how often each chunk occurs, added up per batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            found: dict[tuple[int, int], int] = {}
            for content, ends in chunked(batch.column(0)):
                start = 0
                for end in ends:
                    digest = chunk_digest(content[start:end])
                    found[digest] = found.get(digest, 0) + 1
                    start = end
            keys = np.array(list(found), dtype=np.int64).reshape(-1, 2)
            columns = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "n"])

    counts = docs.select(text).mapInArrow(run, "h1 bigint, h2 bigint, n bigint")
    return counts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _shared_filter(counts: DataFrame) -> bytes:
    """The bit filter of all chunks that occur twice or more; its words, not the chunks, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for places in filter_places(batch.column("h1").to_numpy(), batch.column("h2").to_numpy()):
                np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        words = bits.view(np.int64)
        used = np.flatnonzero(words)
        for at in range(0, len(used), 1 << 16):
            some = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], ["at", "word"])

    found = counts.filter("n > 1").select("h1", "h2").mapInArrow(run, "at bigint, word bigint")
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for batch in found.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow().to_batches():
        words[batch.column("at").to_numpy()] = batch.column("word").to_numpy()
    return words.tobytes()


class _Cutter:
    """Cuts texts into parts: shared chunks, and what stands between them."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, np.uint8)

    def parts(self, column: pa.Array) -> list[list[tuple[bytes, tuple[int, int] | None]]]:
        """For each text its parts ``(content, digest)``; the digest of a part that is not shared is None."""
        texts = list(chunked(column))
        chunks = [(at, content[a:b]) for at, (content, ends) in enumerate(texts) for a, b in zip([0, *ends], ends)]
        digests = [chunk_digest(chunk) for _, chunk in chunks]
        keys = np.array(digests, dtype=np.int64).reshape(-1, 2)
        places = filter_places(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
        shared = reduce(np.logical_and, ((self.bits[p >> 3] >> (p & 7)) & 1 for p in places)).tolist()
        rows: list[list[tuple[bytes, tuple[int, int] | None]]] = [[] for _ in texts]
        for (at, chunk), digest, common in zip(chunks, digests, shared):
            row = rows[at]
            if common:
                row.append((bytes(chunk), digest))
            elif row and row[-1][1] is None:
                row[-1] = (row[-1][0] + bytes(chunk), None)
            else:
                row.append((bytes(chunk), None))
        return rows


def _encoder(state: dict) -> WordEncoder:
    if "encoder" not in state:
        state["encoder"] = WordEncoder(state["model"])
    return state["encoder"]


def encode(
    docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True
) -> DataFrame:
    """``docs`` with the token ids of each text (array of int), and with ``decoded`` the text these ids stand for.

    Equal to the tokenizers library with the model's JSON ``model``, without added special tokens, truncation and padding.
    A model must give white space no ids and encode words apart. Special strings within a text are the library's special
    tokens. Decoding keeps special tokens. A null or empty text has no ids and an empty decoded text. Other columns stay,
    and the text unless ``keep_text`` is false; columns named as the results are replaced, repeated rows stay repeated, an
    empty table gives no rows.
    """
    keep_text = keep_text and text not in (ids, decoded)
    source, row, parts = (free_name(docs.columns, name) for name in ("source_text", "row", "parts"))
    named = docs.select(*(F.col(c).alias(source) if c == text else F.col(c) for c in docs.columns))
    given = named.select(*(c for c in named.columns if c not in (ids, decoded)))
    texts = given.select(source)
    carried = [f for f in given.schema.fields if f.name != source or keep_text]
    shared = shared_state(docs.sparkSession, model=model, bits=_shared_filter(_counted(texts, source)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, encoder = _Cutter(shared.value["bits"]), _encoder(shared.value)
        for batch in text_chunks(batches, source):
            rows = []
            for found in cutter.parts(batch.column(source)):
                rows.append([(*digest, *[None] * 5) if digest else (None, None, *encoder.coded(part)) for part, digest in found])
            made = pa.array([[dict(zip(_PART.names, part)) for part in found] for found in rows], _PARTS)
            columns = [batch.column(f.name) for f in out.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, made], [f.name for f in out.fields])

    out = T.StructType([*carried, T.StructField(parts, T.ArrayType(_PART, False), False)])
    skeleton = materialize(given.mapInArrow(cut, out).withColumn(row, F.monotonically_increasing_id()), "parts")

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(shared.value["bits"])
        for batch in text_chunks(batches, source):
            found = {digest: part for cut in cutter.parts(batch.column(0)) for part, digest in cut if digest}
            keys = np.array(list(found), dtype=np.int64).reshape(-1, 2)
            columns = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(found.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "chunk"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            coded = [encoder.coded(chunk) for chunk in batch.column("chunk").to_pylist()]
            columns = [pa.array([c[k] for c in coded], kind) for k, kind in enumerate(_KINDS[2:])]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), *columns], _PART.names)

    once = texts.mapInArrow(common, "h1 bigint, h2 bigint, chunk binary").groupBy("h1", "h2").agg(F.any_value("chunk").alias("chunk"))
    coded = once.mapInArrow(code, _PART)
    has_shared = F.exists(parts, lambda part: part["h1"].isNotNull())
    places = skeleton.filter(has_shared).select(row, F.posexplode(parts).alias("at", "part"))
    wanted = places.filter(F.col("part.h1").isNotNull()).select(F.col(row).alias("__row"), "at", "part.h1", "part.h2")
    fetched = wanted.join(coded, ["h1", "h2"]).select("__row", F.struct("at", *_CODED).alias("piece"))
    gathered = fetched.groupBy("__row").agg(F.collect_list("piece").alias("__pieces"))
    none = F.lit(None).cast(gathered.schema["__pieces"].dataType)
    whole = skeleton.filter(~has_shared).withColumn("__pieces", none)
    mended = skeleton.filter(has_shared).join(gathered, F.col(row) == F.col("__row")).drop("__row")
    ready = whole.unionByName(mended).drop(row)

    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        added.append(T.StructField(decoded, T.StringType(), False))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            flat, back = [], []
            for own, pieces in zip(batch.column(parts), batch.column("__pieces")):
                held = own.as_py()
                for piece in pieces.as_py() or ():
                    held[piece["at"]] = piece
                flat.append(encoder.ids(joined(held, encoder)))
                if decoded:
                    back.append(encoder.decode(flat[-1]))
            offsets = np.r_[0, np.cumsum([len(x) for x in flat])].astype(np.int32)
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            if decoded:
                columns.append(pa.array(back, pa.string()))
            stay = [batch.column(f.name) for f in carried]
            yield pa.RecordBatch.from_arrays([*stay, *columns], [f.name for f in result.fields])

    result = T.StructType([*carried, *added])
    done = ready.mapInArrow(join, result)
    return done.withColumnRenamed(source, text) if keep_text else done
