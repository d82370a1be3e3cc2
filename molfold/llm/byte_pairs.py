"""Byte-level BPE encoding and decoding with recursive queries.

Text is cut into pieces by a pattern.  In each partition the distinct pieces
become rows of (piece, position, token), one for each byte, in a DuckDB
database of the task's own.  A recursive query joins neighbouring tokens with
the merge table and contracts each piece's pair of least rank, leftmost first,
until no pair of a piece can be merged.  Pairs of bytes that no other merge can
get ahead of, whatever their neighbours become, are contracted beforehand, so
the recursion begins with fewer rows.  Decoding looks all ids of a row up in the
vocabulary at once and gathers their bytes.

Documents are one row each and pieces meet only within a task, so nothing is
shuffled.  Texts wait as numbers of their pieces until there are enough new
pieces for a recursion, so a very long one needs little more memory than
others; the recursion stops after as many rounds as its rows allow and goes on
from where it was.  A task remembers the ids of pieces, up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property
from itertools import islice
from operator import methodcaller

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest vocabulary that is sent to every executor.
MOST_VOCABULARY = 64 << 20
#: Pieces cut at a time, new ones that are encoded together, and all that wait for them.
RUN, NEW, WAITING = 1 << 16, 20_000, 1 << 20
#: Bytes of pieces whose ids a task remembers.
MEMORY = 6 << 20
#: Token rows that one recursion may make.
MOST_ROWS = 1 << 22
#: Tokens decoded at a time.
TOKENS = 1 << 16
#: Above every rank.
NO_RANK = np.iinfo(np.int64).max

#: Every state of every piece, with the round that made it.  A piece leaves the
#: recursion when no pair of it has a rank.  A piece with one least pair loses
#: the row after it; one with several contracts every second of neighbouring
#: ones, counted from the left.
CONTRACT = """
WITH RECURSIVE t(w, s, id, round) AS (
  SELECT w, s, id, 0 FROM start
  UNION ALL
  (WITH p AS (SELECT w, s, id, round, lead(id) OVER v AS next_id, lead(s) OVER v AS next_s FROM t WHERE round < $rounds WINDOW v AS (PARTITION BY w ORDER BY s)),
  m AS (SELECT w, s, id, round, next_s, r.rank FROM p LEFT JOIN merges r ON r.pair = id::BIGINT << 32 | next_id),
  b AS (
    SELECT w, min(rank) AS best, arg_min(s, rank::BIGINT << 32 | s) AS lo, arg_min(next_s, rank::BIGINT << 32 | s) AS gone,
      arg_min(s, rank::BIGINT << 32 | (4294967295 - s)) AS hi
    FROM m WHERE rank IS NOT NULL GROUP BY w),
  lone AS (SELECT m.w, s, CASE WHEN s = lo THEN best ELSE id END AS id, round FROM m JOIN b USING (w) WHERE lo = hi AND s <> gone),
  n AS (
    SELECT m.w, s, id, round, best, rank IS NOT DISTINCT FROM best AS hit, row_number() OVER (PARTITION BY m.w ORDER BY s) AS k
    FROM m JOIN b USING (w) WHERE lo <> hi),
  many AS (
    SELECT *, (k - 1 - coalesce(max(CASE WHEN NOT hit THEN k END) OVER (PARTITION BY w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS gone
    FROM n)
  SELECT w, s, id, round + 1 FROM lone
  UNION ALL
  SELECT w, s, CASE WHEN hit THEN best ELSE id END, round + 1 FROM many WHERE NOT gone)
)
SELECT w, s, id, round FROM t JOIN (SELECT w, max(round) AS round FROM t GROUP BY w) AS ends USING (w, round)
"""

class Numbers(dict):
    """Numbers of pieces in the order they are first seen."""

    def __init__(self, coder: BytePairs) -> None:
        self.coder = coder

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.coder.new.append(piece)
        return number


class BytePairs:
    """A vocabulary's merge table in a DuckDB database in memory, with its query, and the bytes of its tokens."""

    def __init__(self, ranks: bytes, pattern: str = "") -> None:
        self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self._blank()
        self.numbers = Numbers(self)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.merging = False

    def _need_merges(self) -> None:
        """The merge table, made when it is first needed."""
        if self.merging:
            return
        self.merging = True
        made = [(self.ids[t[:k]] << 32 | self.ids[t[k:]], rank) for t, rank in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        pairs, ranks = np.array(made, np.int64).reshape(-1, 2).T
        self._create("merges", pair=np.ascontiguousarray(pairs), rank=ranks.astype(np.int32))
        self._find_certain(pairs >> 32, pairs & 0xFFFFFFFF, ranks)

    def _find_certain(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray) -> None:
        """Tables by two bytes, from which :meth:`_begun` tells the pairs that are merged for certain.

        ``pair`` has the rank of the two bytes as a token, unless a merge of
        that token with another has no higher rank; ``from_left`` the least rank
        by which any token that ends in the first byte takes the second one, and
        ``from_right`` that by which one that begins with the second takes the
        first.  Until a lower rank than these is reached, both bytes stay.
        """
        letters, starts, lengths = self.spelled
        first, last = letters[starts], letters[starts + lengths - 1]

        def least(which: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            table = np.full((256, 256), NO_RANK)
            np.minimum.at(table, (x[which], y[which]), ranks[which])
            return table

        one, other = lengths[left] == 1, lengths[right] == 1
        near = last[left], first[right]
        pair = least(one & other, *near)
        grown = np.minimum(least(lengths[left] == 2, first[left], last[left]), least(lengths[right] == 2, first[right], last[right]))
        self.pair = np.where(grown > pair, pair, NO_RANK)
        self.from_left, self.from_right = least(other, *near), least(one, *near)

    def _begun(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, position, token) rows of the pieces' bytes, pairs that are certain contracted.

        A pair is certain if its rank is below any by which a token on its left
        could take its first byte or one on its right its second.  Such pairs
        never overlap, and what their tokens can merge with has higher ranks,
        so contracting them first changes no choice before their turn comes.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        s = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        w, letters = np.repeat(np.arange(len(pieces)), lengths), np.frombuffer(b"".join(pieces), np.uint8)
        a, b, inside = letters[:-1], letters[1:], w[1:] == w[:-1]
        rank, before, behind = (np.where(inside, t[a, b], NO_RANK) for t in (self.pair, self.from_left, self.from_right))
        at = np.flatnonzero((rank < np.append(NO_RANK, before[:-1])[: len(rank)]) & (rank < np.append(behind[1:], NO_RANK)[: len(rank)]))
        ids, stay = self.single[letters], np.ones(len(w), bool)
        ids[at], stay[at + 1] = rank[at], False
        return w[stay], s[stay], ids[stay]

    def _create(self, name: str, **columns: pa.Array | np.ndarray) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _contracted(self, pieces: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(number, ids as little-endian words) of each piece, once its recursion has ended."""
        if not pieces:
            return
        self._need_merges()
        w, s, ids = self._begun(pieces)
        while len(w):
            self._create("start", w=w.astype(np.int32), s=s.astype(np.int64), id=ids)
            rounds = max(1, min(64, MOST_ROWS // len(w)))
            got = self.db.execute(CONTRACT, {"rounds": rounds}).fetchnumpy()
            order = np.lexsort((got["s"], got["w"]))
            w, s, ids, made = (np.asarray(got[c])[order] for c in ("w", "s", "id", "round"))
            first = np.flatnonzero(np.diff(w, prepend=-1))
            data = ids.astype("<u4").tobytes()
            for number, low, high, ended in zip(w[first].tolist(), first.tolist(), [*first[1:].tolist(), len(w)], (made[first] < rounds).tolist(), strict=True):
                if ended:
                    yield number, data[4 * low : 4 * high]
            going = made == rounds
            w, s, ids = w[going], s[going], ids[going]

    def learn(self) -> None:
        """Encode the pieces that have a number and no ids yet."""
        new = [p.encode() for p in self.new]
        ids = [self.ids.get(piece, -1) for piece in new]
        found: list[bytes] = [b"" if i < 0 else i.to_bytes(4, "little") for i in ids]
        rest = [k for k, i in enumerate(ids) if i < 0]
        for k, data in self._contracted([new[k] for k in rest]):
            found[rest[k]] = data
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        self.size += sum(map(len, new))
        self.new.clear()

    def forget(self) -> None:
        """Give up what is known once it takes more than ``MEMORY``."""
        if self.size > MEMORY:
            self.numbers.clear()
            self._blank()

    def _blank(self) -> None:
        self.new: list[str] = []
        self.starts, self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
        self.size = 0

    def _ids(self, pieces: np.ndarray) -> bytes:
        lengths = self.lengths[pieces]
        offsets = np.repeat(self.starts[pieces] - np.cumsum(lengths) + lengths, lengths)
        return self.flat[offsets + np.arange(len(offsets))].tobytes()

    def encode(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian words of 32 bits."""
        waiting: list[list[np.ndarray]] = []  # numbers of the pieces of whole texts, then of the one at hand
        held = 0
        done: list[bytes] = []  # ids of the start of the first text that waits

        def settle() -> list[bytes]:
            self.learn()
            ids = [self._ids(np.concatenate([np.empty(0, np.int32), *runs])) for runs in waiting]
            self.forget()
            return ids

        for text in texts:
            waiting.append([])
            pieces = map(self.numbers.__getitem__, map(methodcaller("group"), self.pattern.finditer(text)))
            while len(run := np.fromiter(islice(pieces, RUN), np.int32)):
                waiting[-1].append(run)
                held += len(run)
                if len(self.new) >= NEW or held >= WAITING:
                    *whole, rest = settle()
                    if whole:
                        yield b"".join([*done, whole[0]])
                        yield from whole[1:]
                        done = []
                    done.append(rest)
                    waiting, held = [[]], 0
        if waiting:
            whole = settle()
            yield b"".join([*done, whole[0]])
            yield from whole[1:]

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens one after another; start and length by id, length 0 of an id that is not there."""
        starts, lengths = np.zeros((2, max(self.ids.values()) + 1), np.int64)
        ids = np.fromiter(self.ids.values(), np.int64, len(self.ids))
        lengths[ids] = sizes = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        starts[ids] = np.cumsum(sizes) - sizes
        return np.frombuffer(b"".join(self.ids), np.uint8), starts, lengths

    def _bytes(self, ids: np.ndarray) -> bytes:
        letters, starts, lengths = self.spelled
        ids = ids[ids < len(starts)]
        sizes = lengths[ids]
        places = np.repeat(starts[ids] - np.cumsum(sizes) + sizes, sizes)
        return letters[places + np.arange(len(places))].tobytes()

    def decode(self, rows: Iterator[bytes]) -> Iterator[bytes]:
        """Bytes of each row of ids."""
        for row in rows:
            ids = np.frombuffer(row, "<u4")
            yield b"".join(self._bytes(ids[low : low + TOKENS]) for low in range(0, len(ids), TOKENS))


def read_ranks(path: str) -> bytes:
    """A rank file of up to ``MOST_VOCABULARY`` bytes."""
    with open(path, "rb") as f:
        ranks = f.read(MOST_VOCABULARY + 1)
    if len(ranks) > MOST_VOCABULARY:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY} bytes")
    return ranks


def _mapped(values: Column, spark: SparkSession, path: str, pattern: str, encode: bool) -> Column:
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = BytePairs(ranks.value, pattern)
        for batch in batches:
            rows = (v.as_py() for v in batch)
            yield pa.array(list(coder.encode(rows) if encode else coder.decode(rows)), pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()(values)


def encode_text(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned words of 32 bits, one after another).

    ``path`` names a file of base64 tokens and ranks that holds all 256 bytes
    and was made by pair training: no merge makes a pair of a lower rank.
    Special tokens are ordinary text.  A null text is empty and has no ids;
    repeated rows stay repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), _mapped(text, docs.sparkSession, path, pattern, True).alias("ids"))


def decode_ids(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ids: doc_id, ids, decoded (bytes; they need not be whole characters).

    Null ids decode to no bytes; an id that the vocabulary lacks to none of its own.
    """
    ids = F.coalesce(F.col(ids_col), F.lit(b""))
    return tokens.select(F.col(id_col).alias("doc_id"), ids.alias("ids"), _mapped(ids, tokens.sparkSession, path, "", False).alias("decoded"))


def token_report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = decode_ids(encode_text(docs, path, pattern, id_col, text_col), path)
    return coded.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
