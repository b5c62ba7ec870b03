"""Packing by concatenation and cutting.

All documents form one stream of token ids, an end id after each. A first pass tokenizes once, stores each document's
ids with its offset inside its partition, and totals every partition; prefix sums over the totals (one row a
partition) give every document its global offset. The second pass cuts the stream at multiples of the window and
emits one boundary record for each piece. No row is shuffled but the totals.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, saved

#: Words whose ids a worker keeps; beyond it the older half is forgotten before the next texts.
CACHE_WORDS = 750_000
#: Marks that never join a letter or digit before them in one token.
ASCII_MARKS = b".,;:!?%$#&*|"
#: A byte of a character from U+0300 on, where combining marks begin.
BEYOND = re.compile(rb"[\xcc-\xff]")
#: Characters tokenized at once by a worker.
CHUNK_CHARS = 1 << 19
_KEPT: dict[str, CachedTokenizer] = {}


def worker_tokenizer(path: str) -> CachedTokenizer:
    """This worker's tokenizer, kept with its words from task to task."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = CachedTokenizer(path)
    return _KEPT[path]


@lru_cache(maxsize=1 << 16)
def plain_end(c: str) -> bool:
    """Whether a character is a letter or digit and is nothing else once composed and lower-cased: a capital I with dot ends in a combining mark then, which the marks after it join."""
    return all(unicodedata.category(x)[0] in "LN" for x in c + unicodedata.normalize("NFC", c).lower())


class Known(dict):
    """Ids of words. A word without any gets, until they are known, a mark that no id has and its number among the new ones, 15 bits a unit."""

    def of(self, unit: int) -> Known:
        self.mark, self.unit, self.new = b"\xff" * unit, unit, []
        return self

    def __missing__(self, word: bytes) -> bytes:
        i = len(self.new)
        self.new.append(word)
        self[word] = place = self.mark + (i & 0x7FFF).to_bytes(self.unit, "little") + (i >> 15).to_bytes(self.unit, "little")
        return place


class CachedTokenizer:
    """Ids of whole texts from ids of their white-space separated words.

    Exact for tokenizers that compose, lower-case and never join text across white space and drop it; word_bpe_49k is one.
    Words are split as bytes at ASCII white space; what else counts as white space is left to the tokenizer, inside the
    word. Texts without combining marks are composed already, so their A-Z are lower-cased first.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores have workers of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # text that looks like a special token is ordinary text
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        mark = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # stands between words that are encoded together
        self.cache_words = cache_words
        self.known = Known().of(np.dtype(self.dtype).itemsize)

    def _encode(self, words: list[bytes]) -> None:
        """Puts the ids of words into known. Words without the mark are encoded together, the mark between them."""
        known, texts = self.known, [w.decode() for w in words]
        if self.mark is not None:
            joined = [i for i, w in enumerate(words) if b"|" not in w]
            for s in range(0, len(joined), 500):
                some = joined[s : s + 500]
                ids = np.array(self.tokenizer.encode_batch_fast([" | ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, self.dtype)
                cuts = (np.flatnonzero(ids == self.mark) * ids.itemsize).tolist()
                if len(cuts) == len(some) - 1:
                    raw = ids.tobytes()
                    for i, a, b in zip(some, [0, *[c + ids.itemsize for c in cuts]], [*cuts, len(raw)], strict=True):
                        known[words[i]] = raw[a:b]
        rest = [i for i, w in enumerate(words) if self._unknown(w)]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            known[words[i]] = np.array(e.ids, self.dtype).tobytes()

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Puts the ids of new words into known, and returns them in order."""
        known, plan, parts = self.known, [], {}
        for w in words:
            core = w.rstrip(ASCII_MARKS)
            if core != w and core and (core[-1:].isalnum() or core[-1] >= 128 and plain_end(core.decode()[-1])):
                marks = w[len(core) :]
                plan.append((core, marks))  # marks after a letter or digit are tokens of their own
                parts[core] = parts[marks] = None
            else:
                plan.append((w, b""))
                parts[w] = None
        self._encode([p for p in parts if self._unknown(p)])
        own = [known[core] + known[marks] if marks else known[core] for core, marks in plan]
        known.update(zip(words, own, strict=True))
        known.new = []
        return own

    def _unknown(self, word: bytes) -> bool:
        ids = self.known.get(word)
        return ids is None or ids.startswith(self.known.mark)

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """For each text its ids and then end, as little-endian bytes of self.dtype.

        One look-up a word: a new one is given a mark and a number in the place of its ids, and those are filled in when
        all new words of the texts are encoded together.
        """
        tail = np.array([end], self.dtype).tobytes()
        if len(self.known) > self.cache_words:  # the older half goes
            self.known = Known(islice(self.known.items(), len(self.known) // 2, None)).of(np.dtype(self.dtype).itemsize)
        get, mark, out = self.known.__getitem__, self.known.mark, []
        for t in texts:
            x = t.encode()
            out.append(b"".join(map(get, (x if BEYOND.search(x) else x.lower()).split())))
        own = self._learn(self.known.new)
        if own:
            unit = len(mark)
            number = lambda p: int.from_bytes(p[:unit], "little") | int.from_bytes(p[unit : 2 * unit], "little") << 15
            for i, x in enumerate(out):
                first, *rest = x.split(mark)
                if rest:
                    out[i] = b"".join([first, *chain.from_iterable((own[number(p)], p[2 * unit :]) for p in rest)])
        return [x + tail for x in out]


def chunks(texts: pd.Series, limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of about limit characters, so that memory doesn't follow the batch's longest texts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def tokenized(docs: DataFrame, tokenizer_path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, written once: part, local_start (tokens before the document in its partition), doc_id, n, ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, part, at = worker_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b["t"].fillna("")
            for s in chunks(texts):
                ids = tok.encode(texts.iloc[s].tolist(), end)
                n = np.array([len(x) for x in ids], np.int64) // np.dtype(tok.dtype).itemsize
                ends = at + np.cumsum(n)
                yield pd.DataFrame({"part": part, "local_start": ends - n, "doc_id": b["d"].iloc[s].to_numpy(), "n": n, "width": np.dtype(tok.dtype).itemsize, "ids": ids})
                at = int(ends[-1])

    # ids travel through pandas as text, where a null doesn't turn whole numbers into floats
    rows = docs.select(F.col(id_col).cast("string").alias("d"), F.col(text_col).alias("t"))
    return saved(rows.mapInPandas(run, "part int, local_start long, doc_id string, n long, width int, ids binary"))


def cut(tokens: DataFrame, window: int) -> DataFrame:
    """Second pass: one row for each piece of a document that lies in one window."""
    totals = saved(tokens.groupBy("part").agg(F.sum("n").alias("total")))
    base = saved(totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for d, n, width, ids, at in zip(b["doc_id"], b["n"], b["width"], b["ids"], b["base"] + b["local_start"], strict=True):
                all_ids = np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")
                done = 0
                while done < n:
                    seq, off = divmod(at + done, window)
                    length = min(window - off, n - done)
                    for k, v in zip(rows, (d, done, length, zlib.crc32(all_ids[done : done + length].tobytes()), n, seq, off), strict=True):
                        rows[k].append(v)
                    done += length
            yield pd.DataFrame(rows, columns=list(rows))

    return tokens.join(broadcast_if_small(base), "part").mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of window tokens; only the last sequence can be shorter.

    docs: any DataFrame with id_col and text_col; other columns are ignored. A null text counts as empty; an empty text
    is its end id alone. Ids may be null or repeat: each row is packed as a document of its own. Very long texts are cut
    into as many pieces as they touch windows. An empty table gives no rows.

    Returns doc_id, start, length, ids_crc32 (CRC-32 of the piece's ids as little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id, offset.
    """
    out = cut(tokenized(docs, tokenizer_path, end, id_col, text_col), window)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
