"""Token ids of texts by a public tokenizer: each distinct word of a block is encoded once, and words' parts are remembered up to a bound.

The tokenizer drops white space and never joins words across it, so a text's ids are its words' ids in a row. It ignores
case, takes a run of letters as one piece, and does not join letters with the punctuation that follows. So A-Z is lowered,
and words of ASCII or Latin-1 letters are parted from the punctuation at their end and encoded many at a time by the tokenizer's
own merges without its slower steps that find such pieces; all other words take the whole way (tests/llm holds all this against
encoding whole texts). Splitting, finding distinct words and putting ids in place are Arrow's work.
"""

from __future__ import annotations

import codecs
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER, END = "word_bpe_49k.json", 1
#: Words that the tokenizer takes as one piece, ASCII and Latin-1 letters, and punctuation after them that is in no contraction or special token.
LETTERS = "[a-zÀ-ÖØ-öø-ÿ]+"
PARTS = f"^(?P<core>{LETTERS})(?P<marks>[.,;:!?*$%&#]*)$"
#: Parts of words after which a generation of remembered ones ends (about 40 bytes each), or else their bytes. Distinct words
#: are sought in BLOCK words at a time.
MEMORY, HELD, BLOCK = 300_000, 64 << 20, 1 << 21
#: Byte-level alphabets write bytes without a visible Latin-1 character as the characters from U+0100 on, in order.
HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
ALPHABET = "".join(chr(b if b not in HIDDEN or b == 0x20 else 256 + HIDDEN.index(b)) for b in range(256))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _remembered(words: pa.StringArray, ids: pa.BinaryArray) -> pa.StructArray:
    return pa.StructArray.from_arrays([words, ids], ["word", "ids"])


def _places(words: pa.StringArray, among: pa.StructArray) -> np.ndarray:
    """Where each word is, -1 if nowhere."""
    return pc.fill_null(pc.index_in(words, value_set=among.field("word")), -1).to_numpy().astype(np.int64)


class Encoder:
    """Ids as little-endian integers; `bound`: parts of words remembered in each of two generations, of which the older one goes."""

    def __init__(self, path: str, bound: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype, self.code = ("<u2", "H") if len(vocabulary) <= 1 << 16 else ("<u4", "I")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        whole = json.loads(self.tokenizer.to_str())
        self.merges = Tokenizer.from_str(json.dumps(whole | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        # Parts of words and their ids, as flat arrays: objects would take four times the memory.
        self.memory = self.older = _remembered(pa.array([], pa.string()), pa.array([], pa.binary()))
        self.bound = bound

    def _each(self, block: pa.StringArray) -> pa.BinaryArray:
        made = self.tokenizer.encode_batch_fast(block.to_numpy(zero_copy_only=False).tolist(), add_special_tokens=False)
        return pa.array([array(self.code, x.ids).tobytes() for x in made], pa.binary())

    def _letters(self, block: pa.StringArray) -> pa.BinaryArray:
        """Words of letters, encoded in one text: each ends at the token that ends a word."""
        text = codecs.charmap_decode(" ".join(block.to_numpy(zero_copy_only=False)).lower().encode(), "strict", ALPHABET)[0]
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(block):
            return self._each(block)
        return pa.BinaryArray.from_buffers(pa.binary(), len(block), [None, pa.py_buffer((np.append(0, cut) * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])

    def _known(self, distinct: pa.StringArray) -> pa.BinaryArray:
        """The ids of each of these, which are remembered."""
        if len(self.memory) > self.bound or self.memory.nbytes > HELD:
            self.older, self.memory = self.memory, self.memory[:0]
        at = _places(distinct, self.memory)
        missing = np.flatnonzero(at < 0)
        words = distinct.take(pa.array(missing))
        was, plain = _places(words, self.older), pc.match_substring_regex(words, f"^{LETTERS}$").to_numpy(zero_copy_only=False).astype(bool)
        known, letters, other = was >= 0, (was < 0) & plain, (was < 0) & ~plain
        more = [self.older.take(pa.array(was[known]))]
        for new, size, encoded in ((letters, 200, self._letters), (other, 2000, self._each)):
            ws = words.filter(pa.array(new))
            more += [_remembered(w, encoded(w)) for w in (ws.slice(a, size) for a in range(0, len(ws), size))]
        at[np.concatenate([missing[x] for x in (known, letters, other)])] = len(self.memory) + np.arange(len(missing))
        self.memory = pa.concat_arrays([self.memory, *more])
        return self.memory.field("ids").take(pa.array(at))

    def _words(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of each word: those of its letters, then those of the punctuation at its end; other words are not parted."""
        parts = pc.extract_regex(words, PARTS)
        both = pa.concat_arrays([pc.coalesce(pc.struct_field(parts, "core"), words), pc.fill_null(pc.struct_field(parts, "marks"), "")]).dictionary_encode()
        ids = self._known(both.dictionary).take(both.indices)
        return pc.binary_join_element_wise(ids[: len(words)], ids[len(words) :], b"")

    def each(self, ws: list[bytes]) -> list[bytes]:
        """The ids of each of these words, in this encoder's type."""
        return self._words(pa.array(ws, pa.binary()).cast(pa.string())).to_numpy(zero_copy_only=False).tolist()

    def encode(self, texts: pa.StringArray, end: int | None = END) -> list[np.ndarray]:
        """The ids of each text, null or not. Distinct words are sought in BLOCK words at a time, so that no text outgrows the memory."""
        texts = texts.fill_null("")
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens know case
        split = pc.ascii_split_whitespace(lowered)  # white space is that of bytes.split(); around it words may be empty, which have no ids
        words, blocks = split.flatten(), []
        for a in range(0, max(1, len(words)), BLOCK):
            found = words.slice(a, BLOCK).dictionary_encode()
            blocks.append(self._words(found.dictionary).take(found.indices))
        joined = pc.binary_join(pa.ListArray.from_arrays(split.offsets, pa.concat_arrays(blocks)), b"")
        if end is not None:
            joined = pc.binary_join_element_wise(joined, array(self.code, [end]).tobytes(), b"")
        return [np.frombuffer(x, self.dtype) for x in joined.to_numpy(zero_copy_only=False)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, bound: int = MEMORY) -> Encoder:
    """This worker's encoder for the file: workers outlive tasks, and so do remembered words."""
    if (path, bound) not in _encoders:
        _encoders[path, bound] = Encoder(path, bound)
    return _encoders[path, bound]
