"""Mixture-controlled packing of documents into training sequences.

Every source is a queue of tokens. Deficit round-robin serves the queues by weight: what a
window of 2048 tokens owes a queue beyond whole tokens is carried to the next window, and
the queues that are owed most get the tokens that rounding leaves over. As documents may be
cut anywhere, the carried deficits have a closed form: after k windows a queue has been
served its share of 2048 k, rounded by largest remainder. So any task can cut any part of
any queue without knowing the rest, deficits cross partitions exactly, and only the last
sequence can be short.

Texts are tokenized once into a written table, where each row knows its place among the rows
of its source in its block. Block totals per source, summed up in order, turn this into the
place in the whole queue; no token moves. A source whose weight owes it less than two tokens a
window shares one joint queue with the others of that kind, so there are at most 1024 queues
plus two, and only their totals come to the driver. The number of sources has no limit. In the
joint queue sources take turns of 32 tokens in the order of tokens so far over weight, sorted
on Spark, so that each has its share of any stretch up to a turn or two; only the tokens of
this queue move. Sources with a target of 0 come last, in a queue of the same kind.

Null text counts as empty: a document of the end token alone. A null source is a source of
its own. Null or repeated ids are separate rows, packed each. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import whole
from riskgraph.operators.ordering import running_totals
from riskgraph.session import materialize

WINDOW = 2048
END = 1
# Words whose ids a task remembers, those that it keeps when they get more, and characters tokenized at once.
REMEMBERED = 600_000
KEPT = 200_000
BATCH_CHARS = 8_000_000
# Pieces of words that go through the tokenizer in one text.
JOINED = 2000
LEAST_SERVED = 2
# Tokens that a source of a shared queue is served at once.
TURN = 32


class Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = place = len(self)
        return place


class WordTokenizer:
    """Ids of texts, each distinct word tokenized once.

    White space always ends a token and is dropped, so the ids of a text are those of its
    words in order. Commas and full stops at the end of a word make tokens of their own where
    an ASCII letter or digit stands before them, so such a word is two pieces that others may
    share. Pieces go through the tokenizer many at a time with a sign between them that none of
    them has: ASCII ones lower-cased and without its normalizer, letters also without its split
    at signs. Pieces with the sign itself or the start of a special token go alone.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_str(definition)
        # One vocabulary serves all three.
        self.plain, self.letters = Tokenizer(self.full.model), Tokenizer(self.full.model)
        self.plain.pre_tokenizer = self.full.pre_tokenizer
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.sign = "²"
        self.forget()

    def forget(self) -> None:
        """Start anew, with an empty piece as number 0."""
        self.word, self.piece = Places(), Places({b"": 0})
        self.stem, self.tail = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def forget_late(self, kept: int) -> None:
        """Keep the words that came first, which the frequent ones are among, and the pieces they need."""
        self.word = Places(islice(self.word.items(), kept))
        self.stem, self.tail = self.stem[:kept].copy(), self.tail[:kept].copy()
        pieces = int(max(self.stem.max(initial=0), self.tail.max(initial=0))) + 1
        self.piece = Places(islice(self.piece.items(), pieces))
        self.starts, self.sizes = self.starts[:pieces].copy(), self.sizes[:pieces].copy()
        self.flat = self.flat[: int((self.starts + self.sizes).max(initial=0))].copy()

    def learn_words(self, words: list[bytes]) -> None:
        """The pieces of words that take the next numbers."""
        known, piece = len(self.piece), self.piece
        stems = [word if word.isalpha() else word.rstrip(b".,") for word in words]
        for i, stem in enumerate(stems):
            if not stem.isalnum() and (not stem[-1:].isalnum() or b"<|" in words[i]):
                stems[i] = words[i]
        tails = [0 if len(word) == len(stem) else piece[word[len(stem) :]] for word, stem in zip(words, stems, strict=True)]
        numbers = [
            piece[stem.lower() if stem.isalnum() or (stem.isascii() and b"<|" not in stem) else stem] for stem in stems
        ]
        self.stem = np.append(self.stem, np.array(numbers, np.int64))
        self.tail = np.append(self.tail, np.array(tails, np.int64))
        self.learn_pieces(list(islice(self.piece, known, None)))

    def learn_pieces(self, pieces: list[bytes]) -> None:
        """The ids of pieces that take the next numbers."""
        kinds: dict[str, list[int]] = {"plain": [], "full": [], "alone": []}
        kinds["letters"] = [i for i, piece in enumerate(pieces) if piece.isalpha()]
        sign = self.sign.encode()
        for i, piece in enumerate(pieces):
            if piece.isalpha():
                continue
            if b"<|" in piece or sign in piece:
                kinds["alone"].append(i)
            else:
                kinds["plain" if piece.isascii() else "full"].append(i)
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        parts, at = [self.flat], len(self.flat)
        for kind, places in kinds.items():
            step = 1 if kind == "alone" else JOINED
            joined = [[pieces[i] for i in places[j : j + step]] for j in range(0, len(places), step)]
            rows, lengths = self.encode_joined(self.full if kind == "alone" else getattr(self, kind), joined)
            parts += rows
            sizes[places] = lengths
            starts[places] = at + np.cumsum(lengths) - lengths
            at += int(lengths.sum())
        self.flat = np.concatenate(parts)
        self.starts, self.sizes = np.append(self.starts, starts), np.append(self.sizes, sizes)

    def encode_joined(self, encoder, groups: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of every group without the signs, and the number of ids of every piece."""
        rows, lengths = [], [np.zeros(0, np.int64)]
        (sign_id,) = encoder.encode(self.sign, add_special_tokens=False).ids
        texts = [f" {self.sign} ".encode().join(group).decode() for group in groups]
        for found, group in zip(encoder.encode_batch_fast(texts, add_special_tokens=False), groups, strict=True):
            row = np.array(found.ids, np.uint32)
            if len(group) > 1:
                signs = np.flatnonzero(row == sign_id)
                lengths.append(np.diff(np.concatenate(([-1], signs, [len(row)]))) - 1)
                rows.append(np.delete(row, signs))
            else:
                lengths.append(np.array([len(row)], np.int64))
                rows.append(row)
        return rows, np.concatenate(lengths)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text with the end token after them."""
        if len(self.word) > REMEMBERED:
            self.forget_late(KEPT)
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        known = len(self.word)
        index = np.fromiter(map(self.word.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.learn_words(list(islice(self.word, known, None)))
        pieces = np.stack([self.stem[index], self.tail[index]], axis=1).ravel()
        sizes = self.sizes[pieces]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.starts[pieces] - before, sizes) + np.arange(sizes.sum())]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        bounds = ends[2 * np.concatenate(([0], np.cumsum(counts)))]
        return [np.append(ids[a:b], np.uint32(END)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=1)
def tokenizer(definition: str) -> WordTokenizer:
    return WordTokenizer(definition)


def tokenized(docs: DataFrame, definition: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, block, local, n_tokens, ids: ``local`` counts the source's tokens before it in the block."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        block, served = TaskContext.get().partitionId(), {}
        words = tokenizer(shared.value)
        for batch in batches:
            lengths = batch["text"].map(len).cumsum() // BATCH_CHARS
            for _, part in batch.groupby(lengths, sort=False):
                rows = words.encode(list(part["text"]))
                local = []
                for source, ids in zip(part["source"], rows, strict=True):
                    local.append(served.get(source, 0))
                    served[source] = local[-1] + len(ids)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "source": part["source"],
                        "block": block,
                        "local": local,
                        "n_tokens": [len(ids) for ids in rows],
                        "ids": [ids.astype("<u2" if ids.max() < 65536 else "<u4").tobytes() for ids in rows],
                    }
                )

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")).alias("source"),
        whole(F.col(text_col)).cast("binary").alias("text"),
    )
    return rows.mapInPandas(
        encode, f"doc_id {kind}, source string, block long, local long, n_tokens long, ids binary"
    )


class Schedule:
    """Tokens served to every queue after k windows."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int) -> None:
        self.totals, self.window = totals, window
        self.total = int(totals.sum())
        rest, active = totals.astype(float), totals > 0
        at, served = [0.0], [np.zeros(len(totals))]
        while active.any():
            # Weight 0 waits until all others have ended.
            wanted = np.where(active, weights if weights[active].any() else rest, 0)
            share = wanted / wanted.sum()
            need = np.full(len(totals), np.inf)
            need[share > 0] = rest[share > 0] / share[share > 0]
            step = need.min()
            rest = np.where(need <= step * (1 + 1e-9), 0, rest - share * step)
            active &= rest > 0
            at.append(at[-1] + step)
            served.append(totals - rest)
        at[-1] = float(self.total)
        self.at, self.served = np.array(at), np.array(served)

    def after(self, k: np.ndarray) -> np.ndarray:
        """One row per k, one column per queue: shares of window * k, rounded by largest remainder."""
        position = np.minimum(k * self.window, self.total)
        x = np.stack([np.interp(position, self.at, column) for column in self.served.T], axis=1)
        whole_tokens = np.minimum(np.floor(x).astype(np.int64), self.totals)
        owed = np.where(whole_tokens < self.totals, x - whole_tokens, -1.0)
        left = position - whole_tokens.sum(axis=1)
        place = np.argsort(np.argsort(-owed, axis=1, kind="stable"), axis=1, kind="stable")
        return whole_tokens + (place < left[:, None])

    def windows_of(self, queue: int, first: int, last: int) -> np.ndarray:
        """Window numbers that surely include all that hold tokens first..last of the queue."""
        begin = np.interp(first, self.served[:, queue], self.at) // self.window
        # A queue ends where its total is first reached, not with the last window.
        served, place = np.unique(self.served[:, queue], return_index=True)
        end = np.interp(last + 1, served, self.at[place]) // self.window
        return np.arange(max(0, int(begin) - 2), int(end) + 4)


def weights_of(blocks: DataFrame, targets: Mapping[str, float] | None) -> DataFrame:
    """source, n, weight: the target of a source, or its share of all tokens."""
    by_source = blocks.groupBy("source").agg(F.sum("n").alias("n"))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    wanted = [(str(k), max(0.0, float(v))) for k, v in (targets or {}).items()]
    given = blocks.sparkSession.createDataFrame(wanted, "name string, target double")
    share = F.col("n") / F.lit(float(total or 1))
    return by_source.join(given, F.col("source") == F.col("name"), "left").select(
        "source", "n", F.coalesce("target", share).alias("weight")
    )


def queues_of(weighted: DataFrame, window: int):
    """Queues of one source {source: number}, number of the joint queue and of the last one, totals and weights.

    Sources of weight 0 make the last queue, other sources without a queue of their own the
    joint one.
    """
    scale = weighted.agg(F.sum("weight")).first()[0] or 0.0
    least = LEAST_SERVED / window * scale
    large, idle = F.col("weight") >= F.lit(least), F.col("weight") <= 0
    # At most window / LEAST_SERVED sources can have such a share.
    own = weighted.filter(large & ~idle).orderBy("source").collect()
    number = {r.source: i for i, r in enumerate(own)}
    totals, shares = [r.n for r in own], [r.weight for r in own]
    small = weighted.filter(~large & ~idle).agg(F.sum("n"), F.sum("weight")).first()
    unwanted = weighted.filter(idle).agg(F.sum("n")).first()[0] or 0
    joint = len(own)
    if small[0] and (small[1] >= least or not own):
        totals.append(small[0])
        shares.append(small[1])
    elif small[0]:
        joint = int(np.argmin(shares))
        totals[joint] += small[0]
        shares[joint] += small[1]
        number = {source: i for source, i in number.items() if i != joint}
    last = len(totals)
    if unwanted:
        totals.append(unwanted)
        shares.append(0.0)
    return number, joint, last, np.array(totals, np.int64), np.array(shares, float)


def turns(nested: DataFrame) -> DataFrame:
    """of_source, turn, place: where in its queue each turn of a source begins.

    ``nested`` has source, n, weight, queue, until per block. Turn t of a source is its tokens
    from TURN * t on. Turns follow each other by the source's tokens so far over its weight,
    which carries what a source is owed from turn to turn; a shift by a hash of the source
    keeps small sources from meeting in one place.
    """
    first = F.ceil((F.col("until") - F.col("n")) / TURN).cast("long")
    # One turn more than the block may have, so that the sequence never counts down.
    found = nested.select(
        "source", "queue", "weight", "until", "source_n",
        F.explode(F.sequence(first, F.ceil(F.col("until") / TURN).cast("long"))).alias("turn"),
    ).filter(F.col("turn") * TURN < F.col("until"))
    length = F.least(F.lit(TURN).cast("long"), F.col("source_n") - F.col("turn") * TURN)
    phase = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.col("source_n").cast("double"))
    timed = found.select(
        "queue", "source", "turn", length.alias("length"), ((F.col("turn") * TURN + phase * length) / rate).alias("time")
    )
    ordered = running_totals(timed, [F.col("time").asc(), F.col("source").asc(), F.col("turn").asc()], {"until": "length"}, ["queue"])
    return ordered.select(F.col("source").alias("of_source"), F.col("turn").alias("of_turn"), (F.col("until") - F.col("length")).alias("place"))


def in_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows cut where a turn of their source begins."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            width = len(row.ids) // row.n_tokens
            borders = [row.at, *range((row.at // TURN + 1) * TURN, row.at + row.n_tokens, TURN), row.at + row.n_tokens]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                skip = a - row.at
                ids = row.ids[skip * width : (b - row.at) * width]
                rows.append((row.doc_id, row.source, row.queue, a // TURN, a % TURN, b - a, row.n_tokens, skip, ids))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "queue", "turn", "inside", "n_tokens", "doc_tokens", "skip", "ids"])


def pack(
    docs: DataFrame,
    definition: str,
    window: int = WINDOW,
    targets: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``ids`` a piece also carries its token ids. ``definition`` is the tokenizer's JSON.
    ``targets`` gives weights of sources; without it every window has the proportions of the
    whole corpus.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, definition, id_col, text_col, source_col), "tokens")
    blocks = materialize(tokens.groupBy("block", "source").agg(F.sum("n_tokens").alias("n")), "token-blocks")
    weighted = materialize(weights_of(blocks, targets), "source-weights")
    number, joint, last, totals, weights = queues_of(weighted, window)
    known = spark.createDataFrame(list(number.items()) or [("", None)], "name string, number int")
    ordered = running_totals(blocks, [F.col("block").asc()], {"until": "n"}, ["source"])
    of = weighted.select(F.col("source").alias("of"), F.col("n").alias("source_n"), "weight")
    shared = F.when(F.col("weight") > 0, F.lit(joint)).otherwise(F.lit(last))
    offsets = materialize(
        ordered.join(of, F.col("source") == F.col("of"))
        .join(F.broadcast(known), F.col("source") == F.col("name"), "left")
        .select(
            "block", "source", "n", "until", "source_n", "weight",
            F.coalesce("number", shared).alias("queue"), F.col("number").isNull().alias("nested"),
        ),
        "queue-offsets",
    )
    starts = offsets.select(
        F.col("block").alias("b"), F.col("source").alias("s"), "queue", "nested", (F.col("until") - F.col("n")).alias("before")
    )
    placed = tokens.join(starts, (F.col("block") == F.col("b")) & (F.col("source") == F.col("s"))).select(
        "doc_id", "source", "block", "queue", "nested", (F.col("before") + F.col("local")).alias("at"), "n_tokens", "ids"
    )
    kind = docs.schema[id_col].dataType.simpleString()
    rows = placed.filter("not nested").select(
        "doc_id", "block", "queue", "at", "n_tokens", F.col("n_tokens").alias("doc_tokens"), F.lit(0).cast("long").alias("skip"), "ids"
    )
    if len(number) < len(totals):
        cut_rows = placed.filter("nested").select("doc_id", "source", "queue", "at", "n_tokens", "ids").mapInPandas(
            in_turns,
            f"doc_id {kind}, source string, queue int, turn long, inside long, n_tokens long, doc_tokens long, skip long, ids binary",
        )
        places = turns(offsets.filter("nested"))
        # Neighbours in a queue meet in one task, whose rows then lie in few windows.
        served = cut_rows.join(places, (F.col("source") == F.col("of_source")) & (F.col("turn") == F.col("of_turn"))).select(
            "doc_id", F.lit(-1).cast("long").alias("block"), "queue", (F.col("place") + F.col("inside")).alias("at"),
            "n_tokens", "doc_tokens", "skip", "ids",
        )
        served = materialize(served, "turns")
        rows = rows.unionByName(served.repartitionByRange("queue", "at").sortWithinPartitions("queue", "at"))
    schedule = Schedule(totals, weights, window) if len(totals) else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (_, queue), part in batch.groupby(["block", "queue"], sort=False):
                out = pieces(part.sort_values("at"), int(queue), schedule)
                yield out if ids else out.drop(columns="ids")

    return rows.mapInPandas(
        cut,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids array<int>" * ids,
    )


def pieces(part: pd.DataFrame, queue: int, schedule: Schedule) -> pd.DataFrame:
    """Pieces of documents, or of parts of them, in one queue, cut at the window borders."""
    begins, sizes = part["at"].to_numpy(np.int64), part["n_tokens"].to_numpy(np.int64)
    skip, doc_tokens = part["skip"].to_numpy(np.int64), part["doc_tokens"].to_numpy(np.int64)
    ends = begins + sizes
    k = schedule.windows_of(queue, int(begins[0]), int(ends[-1]) - 1)
    served = schedule.after(np.append(k, k[-1] + 1))
    mine = served[:, queue]
    cuts = mine[(mine > begins[0]) & (mine < ends[-1])]
    starts = np.union1d(begins, cuts)
    owner = np.searchsorted(begins, starts, "right") - 1
    inside = starts < ends[owner]
    starts, owner = starts[inside], owner[inside]
    row = np.searchsorted(mine, starts, "right") - 1
    stops = np.minimum(mine[np.minimum(row + 1, len(mine) - 1)], ends[owner])
    ahead = (served[row + 1, :queue] - served[row, :queue]).sum(axis=1)
    raw = part["ids"].to_list()
    ids = [np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype("<u4") for b, n in zip(raw, sizes, strict=True)]
    lo, hi = starts - begins[owner], stops - begins[owner]
    parts = [ids[o][a:b] for o, a, b in zip(owner, lo, hi, strict=True)]
    return pd.DataFrame(
        {
            "doc_id": part["doc_id"].to_numpy()[owner],
            "start": lo + skip[owner],
            "length": hi - lo,
            "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts],
            "doc_tokens": doc_tokens[owner],
            "sequence_id": np.append(k, k[-1] + 1)[row],
            "offset": ahead + starts - mine[row],
            "ids": [p.view(np.int32) for p in parts],
        }
    )
