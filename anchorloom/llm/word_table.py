"""BPE encoding and decoding by a table of distinct words.

The tokenizer never joins words across white space, so a text's ids are its words' ids in a row.
1. Texts are split into words. A batch of texts becomes its distinct words and, for each text, their numbers in order.
2. All batches' words, made distinct, are the word table; each word is encoded once, whatever the number of its texts.
3. Words come back to the batches by joins on the word: at most HOT words, those in most batches, by a broadcast, all others
   by a shuffle, to which a batch sends each word once. What a batch's words gave is gathered and joined to the batch's
   numbers, and ids are put in place by position.
4. Decoding looks pieces up by id in the vocabulary's table, which is as long as the vocabulary (a broadcast join).

A batch ends at four million words or once its distinct words would take about 64 MB of a worker, whatever comes first. Words' ids and
numbers stay flat arrays in workers, and the encoder remembers no words, as each comes to it once.

Batches are made twice, for their words and for their numbers, rather than kept; a digest of the words is part of the key, and a
batch whose words cannot be found fails the query. So docs must give the same rows in the same order each time, as files do.

Defined cases: null text is an empty text, which has no ids and decodes to an empty text; null doc_ids and repeated rows are
encoded each; ids beyond the vocabulary decode to nothing; texts of any length stay whole, one to a batch if need be, and
are split piece by piece; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.tokens import encoder, tokenizer_path

#: Bytes of text that are split at a time, words after which a batch ends, and words that are encoded at a time.
STRETCH, BATCH, BLOCK = 1 << 20, 4_000_000, 20_000
#: Words that are broadcast at most, and their bytes at most: about 30 MB of a worker.
HOT, LONG = 200_000, 64
#: Bytes of distinct words after which a batch ends too (a word counts as OWN bytes more), and words whose ids are put in place at a time.
HELD, OWN, CUT = 64 << 20, 100, 1 << 17
SPACE = re.compile(rb"[ \t-\r]")
BATCHES = "batch long, digest long, n_words long, words array<binary>, doc_id array<long>, many array<long>, low binary, high binary"
WORDS, NUMBERS = ["batch", "digest", "words"], ["batch", "digest", "n_words", "doc_id", "many", "low", "high"]


class Numbers(dict):
    """Words' numbers in order of their first place; held: bytes that the words take, about."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.held += len(word) + OWN
        return n


def prepared(text: str | None) -> bytes:
    """A-Z are lowered, as the tokenizer does, which makes for fewer distinct words; its special tokens know case."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data if b"<|" in data else data.lower()


def stretches(data: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """data in pieces that end at white space."""
    a = 0
    while a < len(data):
        m = SPACE.search(data, a + size)
        b = m.start() if m else len(data)
        yield data[a:b]
        a = b


def batches(docs: DataFrame, columns: list[str], limit: int = BATCH, hot: Broadcast | None = None, held: int = HELD) -> DataFrame:
    """These columns of BATCHES: distinct words and the texts' words as numbers, their low 16 bits and the 8 above.

    With hot, a broadcast of numbers by word, those words have these numbers, the first ones, and n_words counts the others."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)

    def made(key: int, numbers: Numbers, at: list[np.ndarray], docs_: list[int | None], many: list[int]) -> pa.RecordBatch:
        import xxhash

        if len(numbers) + HOT >= 1 << 24:
            raise ValueError("a batch of texts has too many distinct words")
        n, place = len(numbers), np.arange(len(numbers), dtype=np.uint32)
        if hot is not None:
            known = hot.value
            place = np.fromiter((known.get(w, -1) for w in numbers), np.int64, n)
            n = int((place < 0).sum())
            place[place < 0] = np.arange(len(known), len(known) + n)
            place = place.astype(np.uint32)
        low, high = [], []
        if "low" in columns:
            for part in at:
                part = place[part]
                low.append(part.astype("<u2").tobytes())
                high.append((part >> 16).astype(np.uint8).tobytes())
        digest = xxhash.xxh3_64_intdigest(b"\n".join(numbers)) - (1 << 63)
        row = {"batch": key, "digest": digest, "n_words": n, "words": list(numbers) if "words" in columns else [], "doc_id": docs_, "many": many, "low": b"".join(low), "high": b"".join(high)}
        types = {"words": pa.list_(pa.binary()), "doc_id": pa.list_(pa.int64()), "many": pa.list_(pa.int64()), "low": pa.binary(), "high": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([row[c]], types.get(c, pa.int64())) for c in columns], columns)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, size = TaskContext.get().partitionId() << 32, 0
        numbers, at, docs_, many = Numbers(), [], [], []
        for b in found:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = 0
                for part in stretches(prepared(text)):
                    ws = part.split()
                    n += len(ws)
                    part = np.fromiter(map(numbers.__getitem__, ws), np.uint32, len(ws))
                    if "low" in columns:
                        at.append(part)
                docs_.append(doc)
                many.append(n)
                size += n
                if size >= limit or numbers.held >= held:
                    yield made(key, numbers, at, docs_, many)
                    key, size = key + 1, 0
                    numbers, at, docs_, many = Numbers(), [], [], []
        if docs_:
            yield made(key, numbers, at, docs_, many)

    schema = ", ".join(f for f in BATCHES.split(", ") if f.split()[0] in columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, many, ids) of distinct words (word, many), ids as little-endian uint32."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, 0)
        for b in found:
            for at in range(0, b.num_rows, BLOCK):
                block = b.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array([np.frombuffer(x, enc.dtype).astype("<u4").tobytes() for x in enc.each(block.column(0).to_pylist())], pa.binary())], ["word", "many", "ids"])

    return words.select("word", "many").mapInArrow(run, "word binary, many long, ids binary")


def frequent(table: DataFrame, most: int) -> int:
    """A count such that at most `most` words of the table are in that many batches or more."""
    level = F.floor(F.log2("many") * 8).cast("int")
    total, at = 0, 488  # levels of counts, fewer than 512
    for r in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        at = r.level
    return math.ceil(2 ** (at / 8) - 1e-9)


def flat(ids: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an array of ids as one array, and where those of each element begin, with the end; a null has none."""
    if not len(ids):
        return np.empty(0, "<u4"), np.zeros(1, np.int64)
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    if (ends % 4).any():
        raise ValueError("ids are not whole")
    return np.frombuffer(ids.buffers()[2] or b"", "<u4")[ends[0] // 4 : ends[-1] // 4], (ends - ends[0]) // 4


def encode(docs: DataFrame, tokenizer: str | None = None, limit: int = BATCH, most: int = HOT, held_bytes: int = HELD) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of docs (doc_id, text); ids as little-endian uint32.

    limit: words of a batch; most: words that are broadcast; held_bytes: of a batch's distinct words. Results do not depend on them."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    held = common.written(batches(docs, WORDS, limit, held=held_bytes), "zstd")
    each = held.select("batch", F.posexplode("words").alias("k", "word"))
    table = common.written(word_table(each.groupBy("word").agg(F.count("*").alias("many")), path), "zstd")
    common.free_shuffles(spark)
    is_hot = (F.col("many") >= frequent(table, most)) & (F.octet_length("word") <= LONG)
    head = sorted((-r.many, bytes(r.word), bytes(r.ids)) for r in table.where(is_hot).toLocalIterator())  # at most `most`
    hot = spark.sparkContext.broadcast({word: k for k, (_, word, _) in enumerate(head)})
    hot_ids = spark.sparkContext.broadcast((b"".join(ids for *_, ids in head), np.array([len(ids) // 4 for *_, ids in head], np.int64)))
    rare = each.join(F.broadcast(table.where(is_hot).select("word")), "word", "left_anti")
    found = common.written(rare.join(table.where(~is_hot), "word").select("batch", "k", "ids"), "zstd")
    common.free_shuffles(spark)
    gathered = found.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("k", "ids")))["ids"].alias("ids"))
    ids = common.written(held.select("batch", "digest").join(gathered, "batch"), "zstd")
    common.forget(held, table, found)
    common.free_shuffles(spark)
    met = batches(docs, NUMBERS, limit, hot, held_bytes).join(ids, ["batch", "digest"], "left")
    whole = F.when(F.coalesce(F.size("ids"), F.lit(0)) == F.col("n_words"), F.col("ids")).when(F.col("n_words") > 0, F.raise_error(F.lit("docs gave other batches the second time"))).alias("ids")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_flat, hot_many = np.frombuffer(hot_ids.value[0], "<u4"), hot_ids.value[1]
        for b in found:
            for k in range(b.num_rows):
                docs_, many = b.column(0)[k].values, np.array(b.column(1)[k].as_py(), np.int64)
                low, high = (np.frombuffer(b.column(c)[k].as_buffer() or b"", kind) for c, kind in ((2, "<u2"), (3, np.uint8)))
                own, starts = flat(b.column(4)[k].values) if b.column(4)[k].is_valid else (hot_flat[:0], np.zeros(1, np.int64))
                ids, n = np.concatenate([hot_flat, own]), np.concatenate([hot_many, np.diff(starts)])
                starts, ends, first = np.cumsum(n) - n, np.concatenate([[0], np.cumsum(many)]), 0
                while first < len(many):
                    last = min(max(first + 1, int(np.searchsorted(ends, ends[first] + CUT, "right")) - 1), first + 256)
                    made, lengths = [np.empty(0, "<u4")], [np.zeros(1, np.int64)]
                    for a in range(ends[first], ends[last], CUT):
                        cut = slice(a, min(a + CUT, ends[last]))
                        at = low[cut] | high[cut].astype(np.uint32) << 16
                        lengths.append(n[at])
                        up_to = np.cumsum(lengths[-1])
                        made.append(ids[np.repeat(starts[at] + lengths[-1] - up_to, lengths[-1]) + np.arange(up_to[-1])])
                    to = np.cumsum(np.concatenate(lengths))[ends[first : last + 1] - ends[first]]
                    binary = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.array(to * 4, pa.int32()).buffers()[1], pa.py_buffer(np.concatenate(made))])
                    yield pa.RecordBatch.from_arrays([docs_[first:last], pa.array(np.diff(to), pa.int64()), binary], ["doc_id", "n_tokens", "ids"])
                    first = last

    return met.select("doc_id", "many", "low", "high", whole).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def pieces(path: str) -> list[bytes | None]:
    """The vocabulary's pieces by id, special tokens among them."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece.encode()
    return out


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """encoded (ids, ...) with decoded, its text: the ids' pieces joined by one space, special tokens kept. Null ids: null."""
    path = tokenizer or tokenizer_path()
    common.ship(encoded.sparkSession)
    common.small_batches(encoded.sparkSession)
    names = [*encoded.columns, "decoded"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        known, texts = np.array([x is not None for x in table]), pa.array([x and x.decode() for x in table], pa.string())
        for b in found:
            raw = b.column(b.schema.get_field_index("ids"))
            ids, ends = flat(raw)
            there = ids < len(table)
            there[there] = known[ids[there]]
            if not there.all():
                ids, ends = ids[there], np.concatenate([[0], np.cumsum(there)])[ends]
            made = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.take(pa.array(ids))), " ")
            made = pc.if_else(raw.is_valid(), made, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names)

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*encoded.dtypes, ("decoded", "string")]))
