"""Token ids of whole texts by a public tokenizer file, inside Arrow functions.

Texts are cut at ASCII white space where the tokenizer never joins anything:
it drops white space, its merges stay inside a word and its special strings
hold none.  The ids of a text are then those of its words in order, so each
distinct word of a batch is encoded once and the rest is array work.  Any other
tokenizer file gets whole texts, a batch at a time.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landloom.llm.common import per_batch, split_long, text_chunks, word_codes

#: Words, and parts of words, kept between batches in each Python worker.
CACHED_WORDS, CACHED_PARTS = 50_000, 250_000

#: Texts above this many characters are encoded piece by piece.
LONG_CHARS = 4 << 20

_LATIN = "a-zß-öø-ÿ"
#: Words on which Python's lower-casing and letter classes are the tokenizer's: printable ASCII and Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own splitting pattern, on such words.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
#: A word of letters with at most one mark behind it.
_SIMPLE = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,]?)$"

_loaded: dict[str, WordEncoder] = {}


def byte_letters() -> dict[int, str]:
    """Printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of words, as the tokenizers library gives them for a tokenizer file.

    It is ``plain`` only if the file's settings are those that ``_PARTS`` stands
    for.  Then words of common letters go to the library's model part by part,
    which spares its normaliser and splitter, and any other word whole.  For
    other settings whole texts go to the library, as white space may matter.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(self.tok.to_str())
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex", "")
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.vocab = self.tok.get_vocab_size()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, s: str) -> bytes:
        got = self.parts.get(s)
        if got is None:
            mapped = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
            got = self.parts[s] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return got

    def word(self, w: str) -> bytes:
        """Ids of one word as unsigned 32-bit integers."""
        if _PLAIN.fullmatch(w) and not ("<|" in w and any(s in w for s in self.special)):
            return b"".join(map(self.part, _PARTS.findall(w.lower())))
        return array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids in one array, each word's first place and count.

        Words of letters with at most one full stop or comma behind them are
        taken apart in Arrow, so that Python sees their distinct stems only.
        """
        for kept, most in ((self.words, CACHED_WORDS), (self.parts, CACHED_PARTS)):
            if len(kept) > most:
                kept.clear()
        split = pc.extract_regex(words, _SIMPLE)
        stems = pc.utf8_lower(pc.struct_field(split, "stem"))
        stems = pc.if_else(pc.is_valid(split), stems, pa.scalar(None, stems.type)).dictionary_encode()
        src = pc.fill_null(stems.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        mark = pc.fill_null(pc.index_in(pc.struct_field(split, "mark"), pa.array([".", ","], stems.dictionary.type)), -1).to_numpy(zero_copy_only=False)
        mark = np.where(src < 0, -1, mark)
        ids = [self.part(s) for s in stems.dictionary.to_numpy(zero_copy_only=False).tolist()]
        other = np.flatnonzero(src < 0)
        src[other] = len(ids) + np.arange(len(other))
        known = self.words
        for w in words.take(pa.array(other)).to_numpy(zero_copy_only=False).tolist():
            got = known.get(w)
            if got is None:
                got = known[w] = self.word(w)
            ids.append(got)
        own = np.frombuffer(b"".join(ids), np.uint32)
        n_own = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first_own = np.cumsum(n_own) - n_own
        base = n_own[src]
        each = base + (mark >= 0)
        first = np.cumsum(each) - each
        flat = np.empty(int(each.sum()), np.uint32)
        within = np.arange(int(base.sum())) - np.repeat(np.cumsum(base) - base, base)
        flat[np.repeat(first, base) + within] = own[np.repeat(first_own[src], base) + within]
        if (marked := mark >= 0).any():
            flat[first[marked] + base[marked]] = np.frombuffer(self.part(".") + self.part(","), np.uint32)[mark[marked]]
        return flat, first, each

    def lengths(self, text: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.plain:
            return np.diff(self.ids(text)[1])
        codes, starts, words = word_codes(text)
        each = self.coded(words)[2]
        return np.diff(np.concatenate([[0], np.cumsum(each[codes])])[starts])

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids before each text."""
        if not self.plain:
            found = [e.ids for e in self.tok.encode_batch(text.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([0, *map(len, found)])
        codes, starts, words = word_codes(text)
        flat, first, each = self.coded(words)
        n = each[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], n)
        return flat[at], ends[starts]


def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def text_lengths(enc: WordEncoder, text: pa.Array) -> np.ndarray:
    """Ids per text of a column, in byte-balanced steps; long texts piece by piece."""
    out = np.zeros(len(text), np.int64)
    for row, part in text_chunks(text):
        if enc.plain and len(part) == 1 and pc.utf8_length(part)[0].as_py() > LONG_CHARS:
            out[row] = sum(int(enc.lengths(pa.array([p], pa.large_string()))[0]) for p in split_long(part[0].as_py(), LONG_CHARS))
        else:
            out[row : row + len(part)] = enc.lengths(part)
    return out


def encoded(enc: WordEncoder, text: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and ids of each text of a column, with ``end_id`` behind them."""
    for row, part in text_chunks(text):
        if enc.plain and len(part) == 1 and pc.utf8_length(part)[0].as_py() > LONG_CHARS:
            pieces = [enc.ids(pa.array([p], pa.large_string()))[0] for p in split_long(part[0].as_py(), LONG_CHARS)]
            yield row, np.concatenate([*pieces, [end_id]]).astype("<u4")
            continue
        flat, starts = enc.ids(part)
        for k in range(len(part)):
            ids = np.empty(starts[k + 1] - starts[k] + 1, "<u4")
            ids[:-1], ids[-1] = flat[starts[k] : starts[k + 1]], end_id
            yield row + k, ids


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens of every whole text: id, n_bytes, n_tokens, over_limit.

    One Arrow function returns lengths only; no shuffle.  Inside a batch the
    texts are taken in steps of equal bytes, and a text above ``LONG_CHARS``
    is cut at white space.  Null and empty texts have 0 bytes and 0 tokens;
    repeated rows stay; other columns of ``docs`` are not read.
    """
    some = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = some.schema[0].dataType.simpleString()

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n = text_lengths(encoder(tokenizer_path), batch.column(1))
        return {id_col: batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

    return some.mapInArrow(per_batch(columns), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
