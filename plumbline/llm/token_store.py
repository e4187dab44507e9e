"""Token ids as byte planes: encode, shuffle into planes, compress, index, read back.

A store is a folder of Parquet rows, one per chunk of at most ``CHUNK_IDS`` ids, in the
order of (shard, chunk). A chunk's ids are transposed into four byte planes, plane b
holding byte b of every id, and each plane is compressed with zstandard by itself: the
high planes of small vocabularies are all zero and take a few bytes. Beside the planes
stands the chunk's index: where it begins, its documents, how many ids of each it holds,
and whether the first came from the chunk before and the last goes on in the next.
Parquet keeps the store writable and readable wherever Spark's file systems reach, and
commits whole shards when executors are lost.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

CHUNK_IDS = 1 << 16
PLANES = 4
LEVEL = 3
END_ID = 1
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 500_000
#: Texts of so many bytes are encoded together.
TEXTS_BYTES = 1 << 21

#: Letters that normal forms leave alone, then marks; ' and < may begin something else.
MARKS_AFTER = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
PLAIN_WORD = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS_AFTER)}]*)")
LETTERS = [c for c in map(chr, range(256)) if PLAIN_WORD.fullmatch(c)]
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of texts whose characters are all below U+0100.
LATIN = bytes(range(0xC4))
#: Marks that end a word most often, and what a byte is where they are set apart.
WORD_ENDS = ",.;:!?"
LETTER, MARK, SPACE = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(97, 123), *range(0x80, 0xC0), 0xC3]] = LETTER
KINDS[list(WORD_ENDS.encode())] = MARK
KINDS[[0x20, *range(0x09, 0x0E)]] = SPACE
KINDS = KINDS.tobytes()
#: Bytes of letters that are no letters: the signs of times and division.
SIGNS = (b"\xc3\x97", b"\xc3\xb7")
#: New words that make one text for the library.
TOGETHER = 100


def marks_apart(text: bytes) -> tuple[bytes, np.ndarray]:
    """A space before a mark that alone stands between a word of letters and white space.

    The text has no character beyond U+00FF, no ASCII capital and none of SIGNS. Bytes of
    two-byte letters count as letters. The places of the marks come second.
    """
    kinds = np.frombuffer(text.translate(KINDS), np.uint8)
    others = np.flatnonzero(kinds != LETTER)
    kind = kinds[others]
    gap = np.diff(others)
    at = others[1:-1][(kind[:-2] == SPACE) & (kind[1:-1] == MARK) & (kind[2:] == SPACE) & (gap[:-1] > 1) & (gap[1:] == 1)]
    return np.insert(np.frombuffer(text, np.uint8), at, 0x20).tobytes(), at


def joined(texts: list[bytes], apart: bool) -> tuple[bytes, np.ndarray]:
    """Texts, each with a line end, and where each begins; with their marks set apart if asked."""
    data = b"".join([x for t in texts for x in (t, b"\n")])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    if not apart:
        return data, begins
    data, at = marks_apart(data)
    return data, begins + np.searchsorted(at, begins)


class WordEncoder:
    """Encodes texts with a tokenizers file whose pre-tokens never span white space.

    Such a tokenizer gives a text the ids of its white-space separated parts, one after
    the other, and parts repeat: ids are remembered by part. Parts are cut at ASCII white
    space alone; whatever else a tokenizer does inside a part is left to the library.
    Arrow cuts the texts of a block and numbers their different parts, so a part is looked
    up once a block and its ids are copied to all its places.
    The new words of many texts are encoded together, and their ids are cut again where
    the tokenizer's vocabulary marks the end of a word. Words of small ASCII letters alone,
    which nothing but the model changes, skip the steps before it.
    A tokenizer that isn't of this kind must be used with ``whole_texts``.
    """

    def __init__(self, path: str, whole_texts: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.normal, self.cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_low = [a.lower().encode() for a in self.added]
        self.whole_texts = whole_texts
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # what is seen here decides which short cuts hold for this tokenizer
        letters = "".join(LETTERS)
        capitals = "".join(map(chr, range(65, 91)))
        samples = [c.lower() + x for c in LETTERS for x in ("", "a", "zz")] + [letters.lower()]
        one = {w: self._pieces(w) for w in samples}
        self.lowers = bool(self.normal) and self.normal.normalize_str(capitals) == capitals.lower()
        self.plain = (
            bool(suffix)
            and all(len(x) == 1 for x in one.values())
            and all(self._pieces(c) == self._pieces(c.lower()) for c in LETTERS)
            and all(self._pieces(w + MARKS_AFTER) == [*x, *self._pieces(MARKS_AFTER)] for w, x in one.items())
            and self._together(samples) == [self._ids(one[w]) for w in samples]
        )
        # words of small ASCII letters that come through unchanged need the model alone
        small = [w for w in samples if w.isascii()] + ["".join(map(chr, range(97, 123)))]
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.small = (
            self.plain
            and all(self._pieces(w) == [w] for w in small)
            and self._small([w.encode() for w in small]) == [self._ids([w]) for w in small]
        )
        self.apart = self.plain and all(self._pieces(w + m) == [*x, *self._pieces(m)] for w, x in one.items() for m in WORD_ENDS)

    def _pieces(self, text: str) -> list[str]:
        text = self.normal.normalize_str(text) if self.normal else text
        return [p for p, _ in self.cut.pre_tokenize_str(text)] if self.cut else [text]

    def _ids(self, pieces: list[str]) -> bytes:
        return np.array([t.id for p in pieces for t in self.model.tokenize(p)], "<u4").tobytes()

    def _together(self, words: list[str]) -> list[bytes] | None:
        """Ids of words of letters, from one text; None if the words can't be told apart."""
        found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        return self._cut(np.array(found, "<u4"), len(words))

    def _small(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of words of small ASCII letters, by the model alone; None as above."""
        texts = [b" ".join(words[i : i + TOGETHER]).decode() for i in range(0, len(words), TOGETHER)]
        found = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        return self._cut(np.concatenate([np.array(x, "<u4") for x in found]), len(words))

    def _cut(self, ids: np.ndarray, n: int) -> list[bytes] | None:
        """The ids of n words, one after the other, cut where words end."""
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != n or (len(ends) and ends[-1] != len(ids)):
            return None
        data = ids.tobytes()
        begins = [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(begins, begins[1:])]  # noqa: B905

    def _word(self, word: str) -> bytes:
        """What the library does with a text, step by step, without its bookkeeping."""
        if any(a in word for a in self.added):
            return self._text(word)
        return self._ids(self._pieces(word))

    def _text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """Remembers the ids of words that aren't in the new generation."""
        new, old = self.new, self.old
        bases: dict[bytes, str] = {}
        small = []
        marked = []
        for word in words:
            found = old.get(word)
            if found is not None:
                new[word] = found
                continue
            if self.small and word.isalpha() and word.islower():
                small.append(word)
                continue
            text = word.decode()
            plain = PLAIN_WORD.fullmatch(text) if self.plain else None
            if plain is None:
                new[word] = self._word(text)
                continue
            letters, marks = plain.groups()
            low = letters.lower()
            base = word if low == text else low.encode()
            if base not in new:
                if base in old:
                    new[base] = old[base]
                else:
                    bases[base] = low
            if base is not word:
                marked.append((word, base, marks.encode()))
        if small:
            ids = self._small(small)
            if ids is None:
                ids = [self._word(w.decode()) for w in small]
            new.update(zip(small, ids, strict=True))
        if bases:
            ids = self._together(list(bases.values()))
            if ids is None:
                ids = [self._word(w) for w in bases.values()]
            new.update(zip(bases, ids, strict=True))
        for word, base, marks in marked:
            if marks and marks not in new:
                new[marks] = self._word(marks.decode())
            new[word] = new[base] + (new[marks] if marks else b"")

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if self.whole_texts:
            return [self._text(t.decode()) for t in texts]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        out: list[bytes | None] = [None] * len(texts)
        marked: dict[int, bytes] = {}
        others: dict[int, bytes] = {}
        for i, text in enumerate(texts):
            low = text.translate(LOWERED)
            if any(a in low for a in self.added_low):
                out[i] = self._text(text.decode())
            # beyond U+00FF some letters compose with marks as small letters only
            elif not self.lowers or text.translate(None, LATIN):
                others[i] = text
            elif self.apart and not any(x in low for x in SIGNS):
                marked[i] = low
            else:
                others[i] = low
        for own, apart in ((marked, True), (others, False)):
            if own:
                at = list(own)
                data, begins = joined(list(own.values()), apart)
                own.clear()
                for i, ids in zip(at, self._block(data, begins), strict=True):
                    out[i] = ids
        return out

    def _block(self, data: bytes, begins: np.ndarray) -> Iterator[bytes]:
        """Ids of the texts that stand in data, one after the other."""
        ends = np.append(begins, len(data)).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data))
        parts = pc.ascii_split_whitespace(texts)
        numbered = parts.values.dictionary_encode()
        words = numbered.dictionary.cast(pa.large_binary()).to_pylist()
        self._learn(set(words).difference(self.new))
        ids = pa.array(map(self.new.__getitem__, words), pa.large_binary()).take(numbered.indices)
        _, offsets, found = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[parts.offsets.to_numpy()].tolist()
        found = memoryview(found) if found else b""
        return (bytes(found[a:b]) for a, b in zip(at, at[1:]))  # noqa: B905


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, whole_texts: bool) -> WordEncoder:
    """One encoder per worker process and file."""
    if (path, whole_texts) not in _ENCODERS:
        _ENCODERS[path, whole_texts] = WordEncoder(path, whole_texts)
    return _ENCODERS[path, whole_texts]


def to_planes(ids: np.ndarray) -> list[bytes]:
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, PLANES).T
    press = zstandard.ZstdCompressor(level=LEVEL)
    return [press.compress(plane.tobytes()) for plane in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.empty((n, PLANES), np.uint8)
    press = zstandard.ZstdDecompressor()
    for b, plane in enumerate(planes):
        out[:, b] = np.frombuffer(press.decompress(plane, max_output_size=max(1, n)), np.uint8)
    return out.view("<u4").reshape(-1)


class _Chunks:
    """Collects the ids of documents into chunk rows."""

    def __init__(self, shard: int) -> None:
        self.shard, self.chunk, self.first, self.begun = shard, 0, 0, 0
        self.goes_on = False
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.size, self.came = 0, self.goes_on

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        at, begun = 0, self.first + self.size
        while True:
            take = min(len(ids) - at, CHUNK_IDS - self.size)
            if not self.docs:
                self.begun = begun
            self.parts.append(ids[at : at + take])
            self.docs.append(doc_id)
            self.counts.append(take)
            self.size += take
            at += take
            self.goes_on = at < len(ids)
            if self.size == CHUNK_IDS:
                yield self.row()
            if not self.goes_on:
                return

    def row(self) -> dict:
        out = {
            "shard": self.shard,
            "chunk": self.chunk,
            "first": self.first,
            "n_ids": self.size,
            "doc_ids": self.docs,
            "counts": self.counts,
            "begun": self.begun,
            "came": self.came,
            "goes_on": self.goes_on,
            "planes": to_planes(np.concatenate(self.parts)),
        }
        self.chunk, self.first = self.chunk + 1, self.first + self.size
        self.clear()
        return out


def _store_type(id_type: T.DataType) -> T.StructType:
    """begun: where in the shard the chunk's first document began; came: before the chunk."""
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("chunk", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.IntegerType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("begun", T.LongType()),
            T.StructField("came", T.BooleanType()),
            T.StructField("goes_on", T.BooleanType()),
            T.StructField("planes", T.ArrayType(T.BinaryType())),
        ]
    )


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    whole_texts: bool = False,
) -> None:
    """Encode every whole text, append end_id, and write the store to path.

    Documents stand in ascending id order, null ids first, rows of equal ids in the order
    of a hash of their text; a null text is empty and has the end id alone. tokenizer is
    the path of a file that every executor has. Other columns are not looked at.

    Texts are dealt out by ranges of ids before they are encoded, so each is encoded once
    and chunks are made in the order of the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = _store_type(rows.schema["doc_id"].dataType)
    arrow_schema = to_arrow_schema(schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Chunks(TaskContext.get().partitionId())
        encode = encoder(tokenizer, whole_texts).ids
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts, size = [], 0
            for i, x in enumerate(batch.column(1)):
                texts.append(x.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size < TEXTS_BYTES and i + 1 < len(ids):
                    continue
                for doc_id, data in zip(ids[i + 1 - len(texts) : i + 1], encode(texts), strict=True):
                    for row in made.add(doc_id, np.frombuffer(data + end, "<u4")):
                        yield pa.RecordBatch.from_pylist([row], arrow_schema)
                texts, size = [], 0
        if made.docs:
            yield pa.RecordBatch.from_pylist([made.row()], arrow_schema)

    stored = rows.select("doc_id", "text").mapInArrow(chunks, schema)
    stored.write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it, n_tokens its own; the checksum is
    over its ids as little-endian 32-bit numbers. Documents inside one chunk are read
    where the chunk is; only pieces of documents that cross chunks are moved and joined.
    """
    store = spark.read.parquet(path)
    id_type = store.schema["doc_ids"].dataType.elementType
    piece = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("doc_id", id_type),
            T.StructField("begun", T.LongType()),
            T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    arrow_piece = to_arrow_schema(piece)

    def pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"])
                out, at, last = [], 0, len(row["counts"]) - 1
                for i, (doc_id, n) in enumerate(zip(row["doc_ids"], row["counts"], strict=True)):
                    crosses = (i == 0 and row["came"]) or (i == last and row["goes_on"])
                    if crosses != whole:
                        data = ids[at : at + n].tobytes()
                        out.append(
                            {
                                "shard": row["shard"],
                                "doc_id": doc_id,
                                "begun": row["begun"] if i == 0 else row["first"] + at,
                                "at": row["first"] + at,
                                "n_tokens": n,
                                "ids_crc32": zlib.crc32(data) if whole else None,
                                "ids": None if whole else data,
                            }
                        )
                    at += n
                yield pa.RecordBatch.from_pylist(out, arrow_piece)

    names = ["shard", "doc_id", "begun", "n_tokens", "ids_crc32"]
    inside = store.mapInArrow(lambda batches: pieces(batches, True), piece).select(names)

    def joined(rows):
        rows = rows.sort_by("at")
        crc = 0
        for x in rows.column("ids"):
            crc = zlib.crc32(x.as_buffer(), crc)
        total = sum(rows.column("n_tokens").to_pylist())
        first = rows.slice(0, 1)
        return pa.table(
            [
                first.column("shard"),
                first.column("doc_id"),
                first.column("begun"),
                pa.array([total], pa.int64()),
                pa.array([crc], pa.int64()),
            ],
            names=names,
        )

    crossing = (
        store.filter("came or goes_on")
        .mapInArrow(lambda batches: pieces(batches, False), piece)
        .groupBy("shard", "begun")
        .applyInArrow(joined, inside.schema)
    )
    ids = store.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    offsets = ids.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("offset"))
    return (
        inside.union(crossing)
        .join(offsets, "shard")
        .select("doc_id", (F.col("begun") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )
