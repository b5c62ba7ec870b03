"""Document log-likelihoods by a gated recurrent language model, beside an add-one unigram base.

Words of all training documents are counted. The most frequent form the model's tokens; the others stand for one of KINDS
unknown tokens by their shape, and inside a kind a word's probability is its add-one share of the kind's count, so the
model gives every text a proper probability. Training takes all segments of all training documents, dealt by hash, as
runs of windows with truncated backpropagation; replicas of bounded work train in parallel from common weights and are
averaged after each round, so there are more of them the more text there is. Scoring carries the state to a document's end.
Texts are read twice: to count words, and to turn them into tokens, which both training and scoring take from a written
table. Counts of words beyond the broadcast head are joined, not broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, free_name, saved, with_row_number
from .gru import Gru
from .packing import chunks

#: Words whose counts are broadcast at most, bytes of such a word at most; tokens of the model at most.
HEAD, LONG, VOCABULARY = 1 << 18, 64, 4096
#: Tokens in a training segment; tokens that a replica sees in all rounds; rounds.
SEGMENT, REPLICA, ROUNDS = 128, 1 << 21, 3
#: Words counted in a worker before counts are handed on.
COUNTED = 400_000
#: The end of a text as a word: a space, which no word holds.
END = b" "
KINDS = 16
#: The letter for the first kind.
A = 65


def kind_of(word: bytes) -> int:
    """Shape of a word: its last byte (letter, digit or beyond ASCII, full stop, comma, other), bytes beyond ASCII or not, long or not."""
    last = word[-1:]
    shape = 0 if last.isalnum() or last >= b"\x80" else 1 if last == b"." else 2 if last == b"," else 3
    return shape + 4 * (not word.isascii()) + 8 * (len(word) > 8)


def kind_column(word: Column) -> Column:
    """kind_of() of words as text."""
    shape = F.when(word.rlike(r"[a-zA-Z0-9]\z|[^\x00-\x7F]\z"), 0).when(word.endswith("."), 1).when(word.endswith(","), 2).otherwise(3)
    size = F.octet_length(word)
    return shape + F.when(size != F.length(word), 4).otherwise(0) + F.when(size > 8, 8).otherwise(0)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def remainder(doc_id: Column, of: int = 7) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % of


def count_words(texts: DataFrame) -> DataFrame:
    """word, kind, n over column t, one END for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"word": b"\n".join(c).decode().split("\n"), "n": np.fromiter(c.values(), np.int64, len(c))})
            c.clear()
            return frame

        for b in batches:
            t = b["t"].fillna("")
            for s in chunks(t):
                for x in t.iloc[s]:
                    c.update(words_of(x))
                c[END] += s.stop - s.start
                if len(c) > COUNTED:
                    yield out()
        if c:
            yield out()

    n = texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return saved(n.select("word", kind_column(F.col("word")).alias("kind"), "n"))


class Lexicon:
    """The head of the counts: word numbers, their counts, their tokens; and the totals."""

    def __init__(self, counts: DataFrame, head: int = HEAD, vocabulary: int = VOCABULARY):
        self.total, self.distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
        end = counts.where(F.col("word") == END.decode()).first()
        self.end_count = int(end.n) if end else 0
        words = counts.where(F.col("word") != END.decode())
        short = words.where(F.octet_length("word") <= LONG)
        left, least = head, None
        for r in short.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(head).toLocalIterator():
            if r.words > left:
                break
            left, least = left - r.words, r.n
        rows = short.where(F.col("n") >= least).collect() if least is not None else []
        rows = sorted((-r.n, r.word.encode(), r.kind) for r in rows)
        self.words = [w for _, w, _ in rows]
        self.count = np.array([-n for n, _, _ in rows], np.int64)
        self.kind = np.array([k for _, _, k in rows], np.int8)
        known = np.arange(min(len(rows), vocabulary - KINDS - 1))
        # counts and words of each kind outside the model's tokens
        by_kind = {r.kind: (r.n, r.words) for r in words.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
        self.tail_n, self.tail_words = (np.array([by_kind.get(k, (0, 0))[j] for k in range(KINDS)], np.int64) for j in (0, 1))
        np.subtract.at(self.tail_n, self.kind[known], self.count[known])
        np.subtract.at(self.tail_words, self.kind[known], 1)
        # tokens in falling order of frequency: kinds, end, known words
        freq = np.concatenate([self.tail_n, [self.end_count], self.count[known]])
        order = np.argsort(-freq, kind="stable")
        token = np.empty(len(freq), np.int64)
        token[order] = np.arange(len(freq))
        self.freq, self.kind_token, self.end_token = freq[order], token[:KINDS], int(token[KINDS])
        self.token = self.kind_token[self.kind] if len(rows) else np.zeros(0, np.int64)
        self.token[known] = token[KINDS + 1 :]
        # log10 probabilities of the base, and of a word in its kind (0 for the model's own tokens)
        self.unit = self.total + self.distinct + 1
        self.base = np.log10((self.count + 1) / self.unit)
        self.kind_unit = self.tail_n + self.tail_words + 1
        self.inside = np.log10((self.count + 1) / self.kind_unit[self.kind]) if len(rows) else np.zeros(0)
        self.inside[known] = 0.0
        self.end_base = math.log10((self.end_count + 1) / self.unit)

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def tokenized(docs: DataFrame, shared) -> DataFrame:
    """row, d, held_out, n_tokens, n_known, base, inside (sums over words of the head), tokens (unsigned 16 bit), tail, written once.

    tail: the words beyond the head, a space between them and each after a letter for its kind. docs: row, d, held_out, t.
    shared: a broadcast Lexicon.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex: Lexicon = shared.value
        get = lex.index().get
        token, base, inside = (np.append(x, 0) for x in (lex.token.astype("<u2"), lex.base, lex.inside))  # -1 is no word of the head
        marks = [bytes([A + k]) for k in range(KINDS)]
        for b in batches:
            t = b.pop("t").fillna("")
            for s in chunks(t):
                each = [words_of(x) for x in t.iloc[s]]
                n = np.array([len(w) for w in each], np.int64)
                flat = list(chain.from_iterable(each))
                at = np.fromiter(map(get, flat, repeat(-1)), np.int32, len(flat))
                owner = np.repeat(np.arange(len(n)), n)
                own = token[at]
                beyond = np.flatnonzero(at < 0)
                words = [flat[i] for i in beyond.tolist()]
                kinds = list(map(kind_of, words))
                own[beyond] = lex.kind_token[np.array(kinds, np.int64)]
                marked = [marks[k] + w for k, w in zip(kinds, words, strict=True)]
                cuts = np.searchsorted(owner[beyond], np.arange(len(n) + 1)).tolist()
                stops = np.cumsum(n + 1)
                tokens = np.full(int(stops[-1]) if len(n) else 0, lex.end_token, "<u2")
                tokens[np.arange(len(flat)) + owner] = own
                raw, ends = tokens.tobytes(), (2 * stops).tolist()
                yield b.iloc[s].assign(
                    n_tokens=n + 1, n_known=n - np.diff(cuts) + (lex.end_count > 0), base=np.bincount(owner, base[at], len(n)) + lex.end_base, inside=np.bincount(owner, inside[at], len(n)),
                    tokens=[raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], tail=[b" ".join(marked[x:y]).decode() for x, y in zip(cuts, cuts[1:], strict=False)],
                )

    return saved(docs.select("row", "d", "held_out", "t").mapInPandas(run, "row long, d string, held_out boolean, n_tokens long, n_known long, base double, inside double, tokens binary, tail string"))


def segments(tokens: DataFrame) -> DataFrame:
    """Training segments: tokens (unsigned 16 bit), their number, and a hash of row and place. tokens: row, tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = 2 * SEGMENT
        for b in batches:
            rows = [(x[i : i + step], len(x[i : i + step]) // 2, zlib.crc32(b"%d %d" % (r, i))) for r, x in zip(b["row"], b["tokens"], strict=True) for i in range(0, len(x), step)]
            yield pd.DataFrame(rows, columns=["tokens", "n", "h"])

    return tokens.select("row", "tokens").mapInPandas(run, "tokens binary, n int, h long")


def averaged(parts: DataFrame, replicas: int) -> np.ndarray:
    """Mean of the replicas' weights, by their tokens; sums meet in two steps."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mass = None, 0
        for b in batches:
            for w, n in zip(b["w"], b["n"], strict=True):
                x = np.frombuffer(w, np.float64)
                total, mass = x if total is None else total + x, mass + n
        if total is not None:
            yield pd.DataFrame({"w": [total.tobytes()], "n": [mass]})

    rows = parts.repartition(max(1, math.isqrt(replicas))).mapInPandas(merge, "w binary, n long").collect()
    return sum(np.frombuffer(r.w, np.float64) for r in rows) / sum(r.n for r in rows)


def replica_round(shared, rate: float, seed: int, r: int):
    """A function that trains one replica on its segments of a round: its weights times its tokens, and those tokens."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        freq, flat = shared.value
        own, b = Gru(freq, seed=seed).put(flat), b.sort_values(["h", "tokens"])
        own.train([np.frombuffer(x, "<u2").astype(np.int64) for x in b["tokens"]], rate, seed=seed + r)
        n = int(b["n"].sum())
        return pd.DataFrame({"w": [(own.get().astype(np.float64) * n).tobytes()], "n": [n]})

    return run


def train(parts: DataFrame, lex: Lexicon, seed: int = 0, rate: float = 6e-3) -> Gru:
    """Trains on each of segments() in one round: the first is one replica's alone, the other replicas' segments are all in the later ones."""
    model = Gru(lex.freq, seed=seed)
    replicas = max(4, -(-lex.total // REPLICA))
    turn = F.floor(F.col("h") / replicas)
    dealt = parts.withColumn("replica", F.pmod(F.col("h"), F.lit(replicas))).withColumn("round", F.when(F.col("replica") == 0, F.pmod(turn, F.lit(ROUNDS))).otherwise(1 + F.pmod(turn, F.lit(ROUNDS - 1))))
    context = parts.sparkSession.sparkContext
    for r in range(ROUNDS):
        shared = context.broadcast((lex.freq, model.get()))

        own = dealt.where(F.col("round") == r)
        done = saved(own.groupBy("replica").applyInPandas(replica_round(shared, rate / (1 + r), seed, r), "w binary, n long"))
        if done.limit(1).count():
            model.put(averaged(done, replicas))
        drop_saved(done)
        shared.destroy()
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, of: int = 7, seed: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from rows whose crc32(id as text) mod of is not held_out (a null id counts as the text ''). Words are runs
    of bytes other than \\x20 and \\x09 to \\x0D with A-Z lower-cased; each text has one end token more. base_score
    and score are log10 probabilities. A null text is empty: one end token. Ids may be null or repeat: rows are scored
    each for itself. Other columns are ignored. Without training rows every word is unknown. An empty table gives an
    empty table.
    """
    row = free_name(docs, "lm_row")
    d = with_row_number(docs, row).select(F.col(row).alias("row"), F.col(id_col).cast("string").alias("d"), (remainder(F.col(id_col), of) == held_out).alias("held_out"), F.col(text_col).alias("t"))
    counts = count_words(d.where(~F.col("held_out")).select("t"))
    lex = Lexicon(counts)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(lex)
    tokens = tokenized(d, shared)
    model = train(segments(tokens.where(~F.col("held_out"))), lex, seed)
    weights = context.broadcast((lex.freq, model.get()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq, flat = weights.value
        own = Gru(freq, seed=seed).put(flat)
        for b in batches:
            x = [np.frombuffer(t, "<u2") for t in b.pop("tokens")]
            yield b.assign(model=own.score(x) / math.log(10))

    plain = "row long, d string, held_out boolean, n_tokens long, n_known long, base double, inside double"
    scored = tokens.drop("tail").mapInPandas(run, f"{plain}, model double")
    rare = tokens.where("tail <> ''").select("row", F.explode(F.split("tail", " ")).alias("x")).select("row", F.substring("x", 2, 1 << 30).alias("w"), (F.ascii("x") - A).alias("k"))
    unit = F.element_at(F.array(*[F.lit(float(x)) for x in lex.kind_unit]), F.col("k") + 1)
    c = F.coalesce(F.col("c"), F.lit(0))
    found = rare.join(counts.select("word", F.col("n").alias("c")), F.col("w") == F.col("word"), "left").groupBy("row").agg(
        F.sum((c > 0).cast("long")).alias("known"), F.sum(F.log10((c + 1) / F.lit(float(lex.unit)))).alias("rare_base"), F.sum(F.log10((c + 1) / unit)).alias("rare")
    )
    out = scored.join(found, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("d").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("model") + F.col("inside") + F.coalesce("rare", zero)).alias("score"),
    )
